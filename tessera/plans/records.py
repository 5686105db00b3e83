"""Queries over training and benchmark records, derived from the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import compare, metrics, records
from tessera.plans.evaluation import _SIDES
from tessera.plans.registry import query
from tessera.sources.tables import EVAL_SQL, eval_results, table

#: Records as SQL that Spark and DuckDB both read.
RECORD = {
    "id": "CASE item_id % 7 WHEN 0 THEN '' WHEN 1 THEN concat('2024_', CAST(item_id AS STRING)) ELSE concat('t', CAST(item_id AS STRING)) END",
    "type": "CASE item_id % 5 WHEN 0 THEN 'concept' ELSE 'code_generation' END",
    "instruction": """CASE item_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN concat(' ', text, chr(10), chr(10), 'Sample input:', chr(10), '3 4 ', chr(10), chr(10), 'Expected output contains: sum, , 7 ', chr(10), 'end') ELSE text END""",
    "topic": "CASE item_id % 3 WHEN 0 THEN NULL ELSE 'geometry' END",
    "year": "CASE item_id % 6 WHEN 0 THEN 2021 END",
    "output": "CASE item_id % 8 WHEN 0 THEN ' ' WHEN 1 THEN 'int main() { return 0; }' WHEN 2 THEN concat('```', chr(10), 'rm -rf /', chr(10), 'pip install x') WHEN 3 THEN 'sudo apt-get install a; curl https://x' ELSE text END",
}
_RECORDS = f"WITH q AS (SELECT {', '.join(f'{x} AS {c}' for c, x in RECORD.items())}, item_id FROM benchmark)"


def rows(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(*[F.expr(x).alias(c) for c, x in RECORD.items()], "item_id")


@query(f"""{_RECORDS} SELECT id, trim(instruction) AS instruction, CASE WHEN contains(instruction, 'Sample') THEN '3 4' ELSE '' END AS sample_input, CASE WHEN contains(instruction, 'Sample') THEN 'sum|7' ELSE '' END AS expected, coalesce(topic, 'unknown') AS topic,
CASE WHEN year IS NOT NULL THEN year WHEN starts_with(id, '2024') THEN 2024 ELSE 0 END AS year FROM q WHERE type = 'code_generation' AND id <> '' AND trim(instruction) <> ''""")
def benchmark_tasks(spark, sf_dir):
    return records.tasks(rows(spark, sf_dir)).withColumn("expected", F.array_join("expected", "|"))


@query("""SELECT item_id, trim(text) || CASE WHEN item_id % 2 = 0 THEN chr(10) || chr(10) || 'Required features:' || chr(10) || '  - one' || chr(10) || '  - two' ELSE '' END || CASE WHEN item_id % 3 = 0 THEN chr(10) || chr(10) || 'Sample input:' || chr(10) || '5' ELSE '' END ||
CASE WHEN item_id % 2 = 0 THEN chr(10) || chr(10) || 'Expected output contains: one, two' ELSE '' END AS instruction, CASE WHEN ends_with(trim(text), '?') OR starts_with(lower(trim(text)), 'write') THEN trim(text) ELSE 'Write a C program for the following:' || chr(10) || chr(10) || trim(text) END AS question FROM benchmark""")
def instructions(spark, sf_dir):
    some = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("one"), F.lit("two"))).otherwise(F.array().cast("array<string>"))
    sample = F.when(F.col("item_id") % 3 == 0, " 5 ")
    question = records.as_question(F.concat(F.col("item_id").cast("string"), F.lit(". "), "text"))
    return table(spark, sf_dir, "benchmark").select("item_id", records.assembled(F.col("text"), some, sample, some).alias("instruction"), question.alias("question"))


@query(f"""{_RECORDS} SELECT item_id, array_to_string(list_filter([CASE WHEN trim(instruction) = '' THEN 'empty_instruction' END, CASE WHEN trim(output) = '' THEN 'empty_output' END,
CASE WHEN type = 'code_generation' AND trim(output) <> '' AND NOT regexp_matches(output, '\\bint\\s+main\\s*\\(') AND NOT contains(output, '```') THEN 'no_code' END], lambda x: x IS NOT NULL), ',') AS issues FROM q""")
def training_issues(spark, sf_dir):
    return rows(spark, sf_dir).select("item_id", F.array_join(records.training_issues(F.col("type"), F.col("instruction"), F.col("output")), ",").alias("issues"))


@query(f"""{_RECORDS} SELECT item_id, 'user: ' || trim(instruction) || ' assistant: ' || trim(output) AS chat, 'Answer in C.' || chr(10) || chr(10) || trim(instruction) AS prompt FROM q""")
def record_shapes(spark, sf_dir):
    s = records.packed(F.col("instruction"), F.col("output"), F.lit("Answer in C."))
    said = F.array_join(F.transform(F.slice(s["messages"], 2, 2), lambda m: F.concat(m["role"], F.lit(": "), m["content"])), " ")
    return rows(spark, sf_dir).select("item_id", said.alias("chat"), s["completion"]["prompt"].alias("prompt"))


@query(f"""{_RECORDS} SELECT item_id, concat_ws(chr(10), nullif(trim(instruction), ''), '', '[Failure type: ' || type || ']', CASE WHEN topic IS NOT NULL THEN '[Repair hint: ' || topic || ']' END, CASE WHEN trim(output) <> '' THEN '[Expected: ' || trim(output) || ']' END) AS user_text FROM q""")
def retry_texts(spark, sf_dir):
    return rows(spark, sf_dir).select("item_id", records.retry_text(F.col("instruction"), F.col("type"), F.col("topic"), F.col("output")).alias("user_text"))


@query(f"""{_RECORDS}, i AS (SELECT item_id, list_filter([CASE WHEN item_id % 8 = 2 THEN 'open_fence' END, CASE WHEN item_id % 8 = 0 THEN 'empty' END], lambda x: x IS NOT NULL) AS own,
list_filter([CASE WHEN item_id % 8 = 2 THEN 'pip' END, CASE WHEN item_id % 8 = 3 THEN 'apt' END, CASE WHEN item_id % 8 = 3 THEN 'url' END, CASE WHEN item_id % 8 = 2 AND NOT regexp_matches(lower(instruction), 'delete|remove|format|wipe') THEN 'rm_root' END], lambda x: x IS NOT NULL) AS bad FROM q)
SELECT item_id, array_to_string(own || bad, ',') AS issues, round_even(greatest(0, least(0.95, 1 - 0.18 * len(bad)) - 0.2 * len(own)), 2)::DOUBLE AS score FROM i""")
def answer_checks(spark, sf_dir):
    found, score = records.answer_score(F.col("output"), F.col("instruction"))
    return rows(spark, sf_dir).select("item_id", F.array_join(found, ",").alias("issues"), score.alias("score"))


@query(f"""{_RECORDS} SELECT item_id, array_to_string(list_filter([CASE WHEN NOT contains(output, '#include') THEN 'include' END, CASE WHEN NOT contains(output, 'int main(') THEN 'main' END, CASE WHEN NOT contains(output, 'return 0') THEN 'return_0' END,
CASE WHEN len(string_split(output, '{{')) <> len(string_split(output, '}}')) THEN 'braces' END, CASE WHEN length(trim(output)) < 50 THEN 'too_short' END], lambda x: x IS NOT NULL), ',') AS issues, length(output)::INT AS code_chars FROM q""")
def minimal_programs(spark, sf_dir):
    return rows(spark, sf_dir).select("item_id", F.array_join(records.program_issues(F.col("output")), ",").alias("issues"), records.style(F.col("output"))["code_chars"].alias("code_chars"))


@query(f"""{EVAL_SQL} SELECT run_id, id, round_even(20 * CASE WHEN NOT coalesce(compile_passed, false) THEN 0 WHEN NOT coalesce(runtime_passed, false) THEN 0.25 WHEN coalesce(keyword_passed, false) AND semantic_passed THEN 1 WHEN coalesce(keyword_passed, false) OR semantic_passed THEN 0.7 ELSE 0.5 END, 1)::DOUBLE AS points,
difficulty IN ('medium', 'hard') AS steps FROM r""")
def case_points(spark, sf_dir):
    ok = lambda c: F.coalesce(F.col(f"{c}_passed"), F.lit(False))
    points = records.case_points(ok("compile"), ok("runtime"), ok("keyword"), ok("semantic"), F.lit(20.0))
    return eval_results(spark, sf_dir).select("run_id", "id", points.alias("points"), records.needs_steps(F.col("difficulty"), F.col("topic")).alias("steps"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN status = 'lost' THEN 'status' END, CASE WHEN level = 'best' THEN 'level' END, CASE WHEN level IN ('human_verified', 'golden') AND reviewer IS NULL THEN 'no_reviewer' END,
CASE WHEN level = 'golden' AND NOT coalesce(list_contains(h, 'approve'), false) THEN 'golden_without_approval' END, CASE WHEN stage = 'review' AND status <> 'in_review' THEN 'not_in_review' END,
CASE WHEN stage = 'verified' AND status NOT IN ('candidate', 'approved', 'golden') THEN 'not_verified' END, CASE WHEN h IS NULL THEN 'no_history' END], lambda x: x IS NOT NULL), ',') AS issues FROM (SELECT doc_id,
CASE doc_id % 4 WHEN 0 THEN 'lost' WHEN 1 THEN 'in_review' ELSE 'approved' END AS status, CASE doc_id % 5 WHEN 0 THEN 'best' WHEN 1 THEN 'golden' WHEN 2 THEN 'human_verified' END AS level, CASE doc_id % 3 WHEN 0 THEN 'review' WHEN 1 THEN 'verified' ELSE 'raw' END AS stage,
CASE WHEN doc_id % 7 < 4 THEN 'r' END AS reviewer, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ['submit', 'approve'] ELSE ['submit'] END AS h FROM documents)""")
def corpus_issues(spark, sf_dir):
    pick = lambda n, *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % n).cast("int"))
    words = lambda *xs: F.array(*map(F.lit, xs))
    actions = F.when(F.col("doc_id") % 6 == 1, words("submit", "approve")).when(F.col("doc_id") % 6 != 0, words("submit"))
    level = pick(5, "best", "golden", "human_verified")
    i = records.item_issues(pick(4, "lost", "in_review", "approved", "approved"), level, pick(3, "review", "verified", "raw"), F.when(F.col("doc_id") % 7 < 4, "r"), actions)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(i, ",").alias("issues"))


_WIDE = _SIDES.replace("topic, coalesce(score, 0) AS score", "topic, compile_passed, runtime_passed, semantic_passed, keyword_passed, coalesce(score, 0) AS score")
_PAIRS = f"""{_WIDE}, w AS (SELECT to_run, id, coalesce(b.topic, n.topic) AS topic, coalesce(b.score, 0) AS base_score, coalesce(n.score, 0) AS new_score, coalesce(n.score, 0) - coalesce(b.score, 0) AS delta,
{", ".join(f"n.{c}_passed::INT - b.{c}_passed::INT AS {c}_change" for c in records.PAIRED)},
array_to_string(list_filter([{", ".join(f"CASE WHEN coalesce(b.{c}_passed, false) AND NOT coalesce(n.{c}_passed, false) THEN '{c}' END" for c in records.PAIRED)}], lambda x: x IS NOT NULL), ',') AS lost,
array_to_string(list_filter([CASE WHEN coalesce(n.score, 0) < coalesce(b.score, 0) THEN 'score' END, CASE WHEN b.runtime_passed AND n.runtime_passed = false THEN 'runtime' END, CASE WHEN b.compile_passed AND n.compile_passed = false THEN 'compile' END,
CASE WHEN b.semantic_passed AND n.semantic_passed = false THEN 'semantic' END, CASE WHEN b.keyword_passed AND n.keyword_passed = false THEN 'keyword' END], lambda x: x IS NOT NULL), ',') AS reasons FROM b FULL JOIN n USING (to_run, id))"""


@query(f"{_PAIRS} SELECT * FROM w")
def wide_pairs(spark, sf_dir):
    return records.wide_pairs(*compare.against_previous(eval_results(spark, sf_dir)), ("to_run", "id"))


@query(f"""{_PAIRS}, g AS (SELECT to_run, bool_or(reasons <> '') AS hit, bool_or(reasons <> '' AND topic IN ('click', 'view')) AS inside, bool_or(reasons <> '' AND topic NOT IN ('click', 'view')) AS outside, coalesce(bool_or(runtime_change < 0), false) AS runtime FROM w GROUP BY to_run)
SELECT to_run, CASE WHEN starts_with(to_run, 'm1') AND inside AND runtime THEN 'overfit_with_runtime_interference' WHEN starts_with(to_run, 'm1') AND outside THEN 'cross_task_interference' WHEN hit THEN 'regression' ELSE 'none' END AS verdict FROM g""")
def interference(spark, sf_dir):
    pairs = records.wide_pairs(*compare.against_previous(eval_results(spark, sf_dir)), ("to_run", "id"))
    return records.interference(pairs, "to_run", "click|view", F.col("to_run").startswith("m1"))


@query(f"""{_PAIRS} SELECT topic, count(*) AS tasks, round_even(avg(delta), 3) + 0::DOUBLE AS avg_delta, count(*) FILTER (delta < 0) AS regressions FROM w GROUP BY topic""")
def deltas_by_field(spark, sf_dir):
    pairs = records.wide_pairs(*compare.against_previous(eval_results(spark, sf_dir)), ("to_run", "id")).withColumns({"base_ok": F.lit(False), "new_ok": F.lit(False)})
    return metrics.delta_groups(pairs, "topic").select("topic", "tasks", "avg_delta", "regressions")


@query(f"{EVAL_SQL} SELECT coalesce(year::VARCHAR, 'unknown') AS year, count(*) AS n, count(*) FILTER (accepted) AS answered, round_even(avg(coalesce(score, 0)), 2) AS avg_score FROM r GROUP BY 1")
def experiment_averages(spark, sf_dir):
    r = eval_results(spark, sf_dir).withColumn("year", F.coalesce(F.col("year").cast("string"), F.lit("unknown")))
    return r.groupBy("year").agg(F.count("*").alias("n"), F.count_if("accepted").alias("answered"), F.bround(F.avg(F.coalesce("score", F.lit(0))), 2).alias("avg_score"))


@query("SELECT p_partkey, regexp_replace(lower(regexp_replace(p_name || ' Tool', '[^A-Za-z0-9]', '', 'g')), 'tool$', '') AS token FROM part")
def canonical_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", records.canonical(F.concat("p_name", F.lit(" Tool"))).alias("token"))
