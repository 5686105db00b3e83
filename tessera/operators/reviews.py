"""Reviews of results: failed checks and causes, validators joined to their specs, matches with registries, changes between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.code import literals
from tessera.functions.text import keywords_found
from tessera.operators.dedup import keep_first, running
from tessera.operators.packaging import issues

#: Checks in the order in which they are told.
CHECKS = ("proxy", "truncation", "structure", "compile", "runtime", "semantic", "keyword")
#: Details that a check's summary lists at most, tokens that evidence lists, least combined score.
DETAILS, LISTED, LEAST = 6, 5, 0.5


def failed_checks(passed: dict[str, Column]) -> Column:
    """Names of the checks that are false; one that is missing hasn't failed."""
    return issues([(name, F.coalesce(~ok, F.lit(False))) for name, ok in passed.items()])


def check_summary(passed: dict[str, Column], details: dict[str, Column]) -> Column:
    """A line for each check that isn't true, missing ones too: ``- name: detail``. details: text, or an array of which the first
    few are joined; without one it says failed. Without failures one line says so."""
    lines = [F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit(f"- {name}: "), F.coalesce(F.nullif(details.get(name, F.lit(None).cast("string")), F.lit("")), F.lit("failed")))) for name, ok in passed.items()]
    return F.coalesce(F.nullif(F.concat_ws("\n", *lines), F.lit("")), F.lit("- no failed checks"))


def listed(values: Column, n: int = DETAILS, mark: str = "; ") -> Column:
    return F.array_join(F.slice(values, 1, n), mark)


def low_score_cause(failed: Column, code: Column, error: Column, timed_out: Column, topic: Column, missing: Column, head: Column, notes: Sequence[tuple[str, Column]] = ()) -> tuple[Column, Column]:
    """Cause of a low score and its evidence: the first rule that fits, in the order a result is made, and further notes.

    failed: names of failed checks; missing: output tokens that weren't found; head: the output's start."""
    has = lambda name: F.array_contains(failed, name)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    lost = has("runtime") & (F.size(F.coalesce(missing, F.array().cast("array<string>"))) > 0)
    undeclared = F.lower(F.coalesce(error, F.lit(""))).rlike("implicit declaration|undeclared")
    rules = [
        (has("proxy") | blank(code), "model_generation_failure", "empty_response"),
        (has("compile") & undeclared, "model_generation_failure", "not_strict_c"),
        (has("compile"), "model_generation_failure", "does_not_compile"),
        (F.coalesce(timed_out, F.lit(False)) & (topic == "game_simulation"), "likely_prompt_ambiguous", "timed_out"),
        (F.coalesce(timed_out, F.lit(False)), "model_generation_failure", "timed_out"),
        (lost & ~blank(head), "expected_token_too_strict", "tokens_missing_from_output"),
        (lost, "checker_rule_mismatch", "no_output"),
        (has("keyword"), "checker_rule_mismatch", "keywords"),
        (has("semantic"), "model_generation_failure", "semantic"),
    ]
    cause, why = F.lit("model_generation_failure"), F.lit(None).cast("string")
    for test, name, evidence in reversed(rules):
        cause, why = F.when(test, name).otherwise(cause), F.when(test, evidence).otherwise(why)
    tokens = F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), listed(missing, LISTED, ", ")))
    more = [F.when(~blank(c), F.concat(F.lit(f"{name}: "), c)) for name, c in notes]
    return cause, F.filter(F.array(why, *more, tokens), lambda x: x.isNotNull())


def token_match(output: Column, tokens: Column) -> dict[str, Column]:
    """found, missing (in the tokens' order) and ratio of tokens that an output holds in any case; 1 without tokens."""
    found, missing = keywords_found(F.coalesce(output, F.lit("")), tokens)
    return {"found": found, "missing": missing, "ratio": F.when(F.size(tokens) == 0, 1.0).otherwise(F.bround(F.size(found) / F.size(tokens), 3))}


def set_changes(before: Column, after: Column) -> dict[str, Column]:
    """Members that are new and that are gone, sorted, each once; a null set is empty."""
    b, a = (F.coalesce(x, F.array().cast("array<string>")) for x in (before, after))
    return {"new": F.array_sort(F.array_except(a, b)), "gone": F.array_sort(F.array_except(b, a))}


def keyword_validation(records: DataFrame, cases: DataFrame, order: str) -> DataFrame:
    """records (id, code) with ok, score, missing, note, by the first case (by order) of their id: its keywords in the code and its
    output tokens in the code's string literals, half each; 1 where it asks for neither. Without a case a record fails."""
    first = keep_first(cases.select(F.col("id").alias("_id"), "keywords", "tokens", order), ["_id"], order).drop(order).withColumn("_known", F.lit(True))
    none = F.array().cast("array<string>")
    j = records.join(first, F.col("id") == F.col("_id"), "left").withColumns({"keywords": F.coalesce("keywords", none), "tokens": F.coalesce("tokens", none)})
    words, texts = token_match(F.col("code"), F.col("keywords")), token_match(literals(F.coalesce("code", F.lit(""))), F.col("tokens"))
    both = F.when((F.size("keywords") == 0) & (F.size("tokens") == 0), 1.0).otherwise((words["ratio"] + texts["ratio"]) / 2)
    score = F.when(F.col("_known"), both).otherwise(0.0)
    missing = F.when(F.col("_known"), F.concat(words["missing"], texts["missing"])).otherwise(none)
    return j.select(*records.columns, (F.col("_known").isNotNull() & (score >= LEAST)).alias("ok"), F.bround(score, 3).alias("score"), missing.alias("missing"), F.when(F.col("_known").isNull(), "no case").alias("note"))


def runtime_validation(records: DataFrame, runs: DataFrame, cases: DataFrame) -> DataFrame:
    """records (id) with ok, ratio, missing, note: a record's run (id, ran, output) must have ended well and hold a token of its
    case (id, tokens). A record without a run fails with a note. runs and cases have an id once."""
    r = runs.select(F.col("id").alias("_run"), "ran", "output")
    c = cases.select(F.col("id").alias("_case"), "tokens")
    j = records.join(r, F.col("id") == F.col("_run"), "left").join(c, F.col("id") == F.col("_case"), "left")
    none = F.array().cast("array<string>")
    m = token_match(F.col("output"), F.coalesce("tokens", none))
    there = F.col("_run").isNotNull()
    ok = there & F.coalesce("ran", F.lit(False)) & (m["ratio"] > 0)
    return j.select(*records.columns, ok.alias("ok"), F.when(there, m["ratio"]).otherwise(0.0).alias("ratio"), F.when(there, m["missing"]).otherwise(none).alias("missing"), F.when(~there, "no executable").alias("note"))


def verified_only(goldens: DataFrame, manifest: DataFrame) -> DataFrame:
    """goldens (id) that the manifest (id, compile_verified, runtime_verified) has as verified; all where it verifies none."""
    good = manifest.where("compile_verified AND runtime_verified").select(F.col("id").alias("_id")).distinct()
    some = good.agg((F.count("*") > 0).alias("_some"))  # one row
    return goldens.join(good, F.col("id") == F.col("_id"), "left").crossJoin(some).where(F.col("_id").isNotNull() | ~F.col("_some")).select(goldens.columns)


def registry_match(comparisons: DataFrame, registry: DataFrame, by: str, stamp: str, value: str) -> DataFrame:
    """comparisons with the value of a registry row of the same ``by``: of those of the same stamp the first by value, else
    of the latest. A comparison without one has null."""
    r = registry.select(F.col(by).alias("_by"), F.col(stamp).alias("_stamp"), F.col(value).alias("_value"))
    exact = r.groupBy("_by", "_stamp").agg(F.min("_value").alias("_exact"))
    last = r.groupBy("_by").agg(F.max_by("_value", F.struct("_stamp", "_value")).alias("_last"))
    j = comparisons.join(exact, (F.col(by) == F.col("_by")) & (F.col(stamp) == F.col("_stamp")), "left").drop("_by", "_stamp").join(last, F.col(by) == F.col("_by"), "left")
    return j.select(*comparisons.columns, F.coalesce("_exact", "_last").alias(value))


def against_baseline(rows: DataFrame, by: str, baseline: str, columns: Sequence[str]) -> DataFrame:
    """rows with <column>_delta to the baseline's row, rounded to three digits; null without a baseline or a value."""
    base = rows.where(F.col(by) == baseline).agg(*[F.first(c).alias(f"_{c}") for c in columns])  # one row
    return rows.crossJoin(base).select(*rows.columns, *[F.bround(F.col(c) - F.col(f"_{c}"), 3).alias(f"{c}_delta") for c in columns])


def best_before(runs: DataFrame, strict: str, stamp: str, value: str) -> DataFrame:
    """runs with best_before: the largest value of strict runs with an earlier stamp, null for the first. The rows of a stamp are
    folded first, and a running maximum over range-partitioned stamps needs no single task."""
    stamps = runs.groupBy(stamp).agg(F.max(F.when(F.col(strict), F.col(value))).alias("_value")).withColumn("_one", F.lit(1))
    before = running(stamps, "_one", stamp, "_value", F.max).select(F.col(stamp).alias("_stamp"), F.col("_before").alias("best_before"))
    return runs.join(before, F.col(stamp) == F.col("_stamp"), "left").drop("_stamp")


def largest_drops(deltas: DataFrame, by: str, delta: str, *ties: str, k: int = 10) -> DataFrame:
    """The k largest drops of each group, from the largest."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(delta, *ties))
    return deltas.where(F.col(delta) < 0).withColumn("rank", n.cast("bigint")).where(F.col("rank") <= k)


def style_changes(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Names of what changed in a program's style: calls that came, an endless loop that came, much longer or shorter code."""
    came = lambda c: after[c] & ~before[c]
    b, a = before["code_chars"], after["code_chars"]
    return issues([
        ("introduced_rand", came("uses_rand")), ("introduced_srand", came("uses_srand")), ("introduced_while_true", came("while_true")), ("longer_code", (a > b * 1.25) & (b > 0)), ("shorter_code", a < b * 0.75),
    ])


def routing_counts(decisions: DataFrame) -> DataFrame:
    """kind, topic, name, n of routing decisions (topic, selected, adapter): by selected, by topic, by both, by adapter (base if none).
    One pass counts all four."""
    d = decisions.select("topic", "selected", F.coalesce("adapter", F.lit("base")).alias("adapter"))
    sets = d.groupingSets([["selected"], ["topic"], ["topic", "selected"], ["adapter"]], "topic", "selected", "adapter")
    g = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 5, "selected").when(F.col("g") == 3, "topic").when(F.col("g") == 1, "topic_selected").otherwise("adapter")
    return g.select(kind.alias("kind"), "topic", F.coalesce("selected", "adapter").alias("name"), "n")


def promotion_summary(results: DataFrame, status: str = "status", tier: str = "tier") -> DataFrame:
    """candidates, approved, human_verified, rejected and a verdict: empty without candidates, pass if all are approved, else partial."""
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    approved = n(F.col(status) == "approved")
    verdict = F.when(F.count("*") == 0, "empty").when(approved == F.count("*"), "pass").otherwise("partial")
    return results.agg(F.count("*").alias("candidates"), approved.alias("approved"), n((F.col(status) == "approved") & (F.col(tier) == "human_verified")).alias("human_verified"), n(F.col(status) == "rejected").alias("rejected"), verdict.alias("verdict"))


def harvested(records: DataFrame) -> DataFrame:
    """Records (id, prompt, solution, accepted) worth keeping as candidates: accepted, with a prompt and a solution; the first of an id."""
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return keep_first(records.where(full("prompt") & full("solution") & F.coalesce("accepted", F.lit(False))), ["id"], "prompt", "solution")


def missing_fields(required: Sequence[str], present: Column) -> Column:
    """Required names that aren't among the present ones (an array), in the required order."""
    return F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce(present, F.array().cast("array<string>")))
