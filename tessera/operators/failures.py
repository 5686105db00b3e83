"""Failure labels of evaluation results: several per row, a primary one, hints, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels in the order that decides which is primary.
LABELS = (
    "syntax_error", "runtime_error", "truncation", "logic_error", "missing_entrypoint", "partial_generation",
    "hallucinated_function", "algorithm_mismatch", "geometry_reasoning", "array_bounds", "io_format_error",
)
#: Signs in a compiler's message and the label that each means.
COMPILER_SIGNS = (("hallucinated_function", "undeclared|implicit declaration"), ("array_bounds", "array|subscript|index"), ("syntax_error", "stray|error: expected"))
#: Words in a topic that mean geometry.
GEOMETRY = "geometry|distance|nearest|point|triangle"
#: Our own hints for each label.
HINTS = {
    "syntax_error": "fix what the compiler rejects", "runtime_error": "make the program run to its end", "truncation": "write the program to its end",
    "logic_error": "check the values step by step", "missing_entrypoint": "add int main", "partial_generation": "answer with a whole program",
    "hallucinated_function": "call declared functions only", "algorithm_mismatch": "choose the method that the task asks for",
    "geometry_reasoning": "check the formula on a drawing", "array_bounds": "check sizes and indexes", "io_format_error": "print exactly the format asked for",
}


def failure_labels(code_empty: Column | None = None) -> Column:
    """All labels of a row, in the order of its checks: the answer, its start and end, then the compiler or the run.

    A missing proxy or truncation check counts as passed, a missing compile check as neither. A compile
    failure that only the answer's state explains, or nothing, is also a syntax error."""
    c = F.col
    failed = lambda x, missing=True: ~F.coalesce(c(x), F.lit(missing))
    no_answer = failed("proxy_passed") if code_empty is None else failed("proxy_passed") | code_empty
    state = F.array_compact(F.array(F.when(no_answer, "partial_generation"), F.when(failed("truncation_passed"), "truncation"), F.when(failed("has_main"), "missing_entrypoint")))
    message = F.lower(F.coalesce("compile_error", F.lit("")))
    told = F.array_compact(F.array(*[F.when(message.rlike(sign), label) for label, sign in COMPILER_SIGNS]))
    so_far = F.concat(state, told)
    plain = (F.size(so_far) == 0) | ((F.size(so_far) == 1) & F.get(so_far, 0).isin("partial_generation", "truncation"))
    compiled = F.concat(so_far, F.when(plain, F.array(F.lit("syntax_error"))).otherwise(F.array().cast("array<string>")))
    ratio = F.coalesce("match_ratio", F.lit(0.0))
    ran = F.when((ratio > 0) & (ratio < 1), F.when(ratio > 0.5, "io_format_error").otherwise("logic_error"))
    ran = ran.when(F.lower("topic").rlike(GEOMETRY), "geometry_reasoning").otherwise("algorithm_mismatch")
    run = F.concat(state, F.when(c("runtime_passed") == F.lit(False), F.array(ran)).otherwise(F.array().cast("array<string>")))
    labels = F.when(c("compile_passed") == F.lit(False), compiled).when(c("compile_passed"), run).otherwise(state)
    return F.when(F.size(labels) == 0, F.array(F.lit("runtime_error"))).otherwise(labels)


def primary(labels: Column) -> Column:
    """The label that comes first in LABELS."""
    return F.get(F.filter(F.array(*map(F.lit, LABELS)), lambda x: F.array_contains(labels, x)), 0)


def hint(label: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv]), label)


def classified(results: DataFrame) -> DataFrame:
    """Rows that weren't accepted, with labels and primary."""
    rows = results.where(~F.coalesce("accepted", F.lit(False))).withColumn("labels", failure_labels())
    return rows.withColumn("primary", primary(F.col("labels")))


def mined(results: DataFrame) -> DataFrame:
    """Counts of failures by view: each primary label, each label, topic, year, model, and topic with primary label.
    One pass: a row of classified() gives a row for each view and key, added up before the shuffle."""
    key = lambda view, x: F.struct(F.lit(view).alias("view"), x.alias("key"))
    single = F.array(
        key("primary", F.col("primary")), key("topic", F.col("topic")), key("year", F.coalesce(F.col("year").cast("string"), F.lit("unknown"))),
        key("model", F.col("model")), key("topic_primary", F.concat_ws("/", "topic", "primary")),
    )
    each = F.concat(single, F.transform("labels", lambda x: key("label", x)))
    return classified(results).select(F.explode(each).alias("x")).groupBy("x.view", "x.key").agg(F.count("*").alias("n"))
