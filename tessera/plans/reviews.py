"""Queries of reviews: failed checks, causes, validators, matches and changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import records as R
from tessera.operators import reviews
from tessera.plans.programs import ANSWER
from tessera.plans.registry import query
from tessera.sources.tables import EVAL_SQL, eval_results, table

_CHECKS = ("proxy", "truncation", "compile", "runtime", "semantic", "keyword")
_FAILED = "list_filter([" + ", ".join(f"CASE WHEN NOT {c}_passed THEN '{c}' END" for c in _CHECKS) + "], lambda x: x IS NOT NULL)"
_MISSING = "CASE WHEN match_ratio < 0.5 THEN [topic, difficulty] ELSE []::VARCHAR[] END"


def _passed():
    return {c: F.col(f"{c}_passed") for c in _CHECKS}


def _missing():
    return F.when(F.col("match_ratio") < 0.5, F.array("topic", "difficulty")).otherwise(F.array().cast("array<string>"))


@query(f"""{EVAL_SQL} SELECT run_id, id, array_to_string({_FAILED}, ',') AS failed, coalesce(nullif(concat_ws(chr(10), {", ".join(
    f"CASE WHEN {c}_passed IS NOT TRUE THEN '- {c}: ' || " + ("coalesce(compile_error, 'failed')" if c == "compile" else f"coalesce(nullif(array_to_string({_MISSING}, '; '), ''), 'failed')" if c == "runtime" else "'failed'") + " END" for c in _CHECKS)}), ''), '- no failed checks') AS summary FROM r""")
def check_summaries(spark, sf_dir):
    details = {"compile": F.col("compile_error"), "runtime": reviews.listed(_missing())}
    return eval_results(spark, sf_dir).select("run_id", "id", F.array_join(reviews.failed_checks(_passed()), ",").alias("failed"), reviews.check_summary(_passed(), details).alias("summary"))


@query(f"""{EVAL_SQL}, f AS (SELECT *, {_FAILED} AS failed, {_MISSING} AS missing, CASE WHEN latency_ms % 2 = 0 THEN 'out' ELSE ' ' END AS head, CASE WHEN seq % 10 > 0 THEN 'int x;' END AS code FROM r WHERE coalesce(score, 0) < 60),
c AS (SELECT *, CASE WHEN list_contains(failed, 'proxy') OR code IS NULL THEN 1 WHEN list_contains(failed, 'compile') AND regexp_matches(lower(coalesce(compile_error, '')), 'implicit declaration|undeclared') THEN 2 WHEN list_contains(failed, 'compile') THEN 3
  WHEN timed_out AND topic = 'game_simulation' THEN 4 WHEN timed_out THEN 5 WHEN list_contains(failed, 'runtime') AND len(missing) > 0 AND trim(head) <> '' THEN 6 WHEN list_contains(failed, 'runtime') AND len(missing) > 0 THEN 7
  WHEN list_contains(failed, 'keyword') THEN 8 WHEN list_contains(failed, 'semantic') THEN 9 ELSE 10 END AS rule FROM f)
SELECT run_id, id, ['model_generation_failure', 'model_generation_failure', 'model_generation_failure', 'likely_prompt_ambiguous', 'model_generation_failure', 'expected_token_too_strict', 'checker_rule_mismatch', 'checker_rule_mismatch', 'model_generation_failure', 'model_generation_failure'][rule] AS cause,
concat_ws('|', ['empty_response', 'not_strict_c', 'does_not_compile', 'timed_out', 'timed_out', 'tokens_missing_from_output', 'no_output', 'keywords', 'semantic', NULL][rule], 'compile: ' || compile_error, CASE WHEN len(missing) > 0 THEN 'missing: ' || array_to_string(missing, ', ') END) AS evidence FROM c""")
def low_score_causes(spark, sf_dir):
    r = eval_results(spark, sf_dir).where(F.coalesce("score", F.lit(0)) < 60)
    r = r.withColumns({"failed": reviews.failed_checks(_passed()), "missing": _missing(), "head": F.when(F.col("latency_ms") % 2 == 0, "out").otherwise(" "), "code": F.when(F.col("seq") % 10 > 0, "int x;")})
    cause, evidence = reviews.low_score_cause(*[F.col(c) for c in ("failed", "code", "compile_error", "timed_out", "topic", "missing", "head")], notes=[("compile", F.col("compile_error"))])
    return r.select("run_id", "id", cause.alias("cause"), F.array_join(evidence, "|").alias("evidence"))


@query(f"""{EVAL_SQL}, s AS (SELECT model, id, stamp, run_id, {_FAILED} AS failed FROM r), p AS (SELECT *, lag(failed) OVER (PARTITION BY model, id ORDER BY run_id) AS before FROM s)
SELECT run_id, id, array_to_string(list_sort(list_filter(failed, lambda x: NOT list_contains(coalesce(before, []), x))), ',') AS new, array_to_string(list_sort(list_filter(coalesce(before, []), lambda x: NOT list_contains(failed, x))), ',') AS gone FROM p""")
def failure_changes(spark, sf_dir):
    r = eval_results(spark, sf_dir).select("model", "id", "run_id", reviews.failed_checks(_passed()).alias("failed"))
    c = reviews.set_changes(F.lag("failed").over(Window.partitionBy("model", "id").orderBy("run_id")), F.col("failed"))
    return r.select("run_id", "id", *[F.array_join(v, ",").alias(k) for k, v in c.items()])


_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 3)"


@query(f"""WITH d AS (SELECT doc_id AS id, 'x = 1; puts("' || left(replace(coalesce(text, ''), '"', ''), 300) || '"); // ' || lang AS code, left(replace(coalesce(text, ''), '"', ''), 300) AS lit FROM documents WHERE doc_id % 3 = 0),
c AS (SELECT item_id * 3 AS id, CASE WHEN item_id % 4 = 0 THEN [] ELSE ['puts', lower(left(text, 4)), 'zz'] END AS keywords, CASE WHEN item_id % 5 = 0 THEN []::VARCHAR[] ELSE {_WORDS}[1:4] END AS tokens FROM benchmark),
m AS (SELECT d.id, c.id IS NOT NULL AS known, coalesce(keywords, []) AS k, coalesce(tokens, []) AS t, list_filter(coalesce(keywords, []), lambda w: NOT contains(lower(code), lower(w))) AS mk, list_filter(coalesce(tokens, []), lambda w: NOT contains(lower(lit), lower(w))) AS mt FROM d LEFT JOIN c USING (id)),
s AS (SELECT *, CASE WHEN NOT known THEN 0 WHEN len(k) + len(t) = 0 THEN 1 ELSE (CASE WHEN len(k) = 0 THEN 1 ELSE round_even((len(k) - len(mk)) / len(k), 3) END + CASE WHEN len(t) = 0 THEN 1 ELSE round_even((len(t) - len(mt)) / len(t), 3) END) / 2 END AS score FROM m)
SELECT id, known AND score >= 0.5 AS ok, round_even(score, 3)::DOUBLE AS score, CASE WHEN known THEN array_to_string(mk || mt, ',') ELSE '' END AS missing, CASE WHEN NOT known THEN 'no case' END AS note FROM s""")
def keyword_validations(spark, sf_dir):
    lit = F.substring(F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit("")), 1, 300)
    d = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit('x = 1; puts("'), lit, F.lit('"); // '), "lang").alias("code"))
    words = F.slice(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 3), 1, 4)
    none = F.array().cast("array<string>")
    b = table(spark, sf_dir, "benchmark").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))  # the first case of an id counts
    keywords = F.when(F.col("copy") == 2, F.array(F.lit("no"))).when(F.col("item_id") % 4 == 0, none).otherwise(F.array(F.lit("puts"), F.lower(F.substring("text", 1, 4)), F.lit("zz")))
    cases = b.select((F.col("item_id") * 3).alias("id"), keywords.alias("keywords"), F.when(F.col("item_id") % 5 == 0, none).otherwise(words).alias("tokens"), "copy")
    return reviews.keyword_validation(d, cases, "copy").select("id", "ok", "score", F.array_join("missing", ",").alias("missing"), "note")


@query(f"""WITH d AS (SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0), u AS (SELECT doc_id AS id, doc_id % 8 <> 0 AS ran, text AS output FROM documents WHERE doc_id % 4 = 0), c AS (SELECT item_id * 2 AS id, {_WORDS}[1:3] AS tokens FROM benchmark),
m AS (SELECT d.id, u.id IS NOT NULL AS there, ran, coalesce(tokens, []) AS t, list_filter(coalesce(tokens, []), lambda w: NOT contains(lower(coalesce(output, '')), w)) AS mt FROM d LEFT JOIN u USING (id) LEFT JOIN c USING (id)),
s AS (SELECT *, CASE WHEN len(t) = 0 THEN 1 ELSE round_even((len(t) - len(mt)) / len(t), 3) END AS ratio FROM m)
SELECT id, there AND coalesce(ran, false) AND ratio > 0 AS ok, (CASE WHEN there THEN ratio ELSE 0 END)::DOUBLE AS ratio, CASE WHEN there THEN array_to_string(mt, ',') ELSE '' END AS missing, CASE WHEN NOT there THEN 'no executable' END AS note FROM s""")
def runtime_validations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    runs = docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 8 != 0).alias("ran"), F.col("text").alias("output"))
    words = F.slice(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 3), 1, 3)
    cases = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 2).alias("id"), words.alias("tokens"))
    out = reviews.runtime_validation(docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id")), runs, cases)
    return out.withColumn("missing", F.array_join("missing", ","))


@query("SELECT s_suppkey AS id, s_name AS text FROM supplier WHERE s_acctbal > 0 AND s_nationkey > 3")
def verified_goldens(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    manifest = s.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 0).alias("compile_verified"), (F.col("s_nationkey") > 3).alias("runtime_verified"))
    return reviews.verified_only(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text")), manifest)


_RUNS = f"{EVAL_SQL}, u AS (SELECT model, run_id, stamp, right(run_id, 2)::INT AS day, count(*) AS tasks, count(*) FILTER (accepted) AS accepted, round_even(avg(coalesce(score, 0)), 2) AS avg_score FROM r GROUP BY ALL)"


def _runs(spark, sf_dir):
    day = F.substring("run_id", -2, 2).cast("int").alias("day")
    return eval_results(spark, sf_dir).groupBy("model", "run_id", "stamp").agg(F.count("*").alias("tasks"), F.count_if("accepted").alias("accepted"), F.bround(F.avg(F.coalesce("score", F.lit(0))), 2).alias("avg_score")).select("*", day)


@query(f"""{_RUNS}, g AS (SELECT * FROM u WHERE day % 3 > 0 AND model <> 'm2') SELECT run_id, model, stamp, coalesce((SELECT min(g.run_id) FROM g WHERE g.model = u.model AND g.stamp = u.stamp), (SELECT arg_max(g.run_id, g.stamp || g.run_id) FROM g WHERE g.model = u.model)) AS entry FROM u""")
def registry_matches(spark, sf_dir):
    u = _runs(spark, sf_dir)
    registry = u.where("day % 3 > 0 AND model <> 'm2'").select("model", "stamp", F.col("run_id").alias("entry"))
    return reviews.registry_match(u.select("run_id", "model", "stamp"), registry, "model", "stamp", "entry")


@query(f"""{_RUNS}, m AS (SELECT model, sum(accepted)::BIGINT AS accepted, round_even(avg(avg_score), 2) AS avg_score FROM u GROUP BY model)
SELECT m.model, m.accepted, m.avg_score, (m.accepted - b.accepted)::BIGINT AS accepted_delta, round_even(m.avg_score - b.avg_score, 3) + 0::DOUBLE AS avg_score_delta FROM m, (SELECT * FROM m WHERE model = 'm1') b""")
def baseline_deltas(spark, sf_dir):
    m = _runs(spark, sf_dir).groupBy("model").agg(F.sum("accepted").alias("accepted"), F.bround(F.avg("avg_score"), 2).alias("avg_score"))
    out = reviews.against_baseline(m, "model", "m1", ["accepted", "avg_score"])
    return out.withColumns({"accepted_delta": F.col("accepted_delta").cast("bigint"), "avg_score_delta": F.col("avg_score_delta") + 0.0})


@query(f"{_RUNS} SELECT run_id, accepted, (SELECT max(b.accepted) FROM u b WHERE b.stamp < u.stamp AND b.day % 2 = 0) AS best_before FROM u")
def best_strict_before(spark, sf_dir):
    u = _runs(spark, sf_dir).withColumn("strict", F.col("day") % 2 == 0)
    return reviews.best_before(u, "strict", "stamp", "accepted").select("run_id", "accepted", "best_before")


@query(f"""{EVAL_SQL}, p AS (SELECT run_id, model, id, coalesce(score, 0) - lag(coalesce(score, 0)) OVER (PARTITION BY model, id ORDER BY run_id) AS delta FROM r)
SELECT model, run_id, id, delta, row_number() OVER (PARTITION BY model ORDER BY delta, id, run_id) AS rank FROM p WHERE delta < 0 QUALIFY rank <= 10""")
def ten_largest_drops(spark, sf_dir):
    score = F.coalesce("score", F.lit(0))
    d = eval_results(spark, sf_dir).withColumn("delta", score - F.lag(score).over(Window.partitionBy("model", "id").orderBy("run_id")))
    return reviews.largest_drops(d.select("model", "run_id", "id", "delta"), "model", "delta", "id", "run_id")


@query(f"""WITH a AS (SELECT conv_id, turn, {ANSWER} AS x FROM conversations), s AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM a),
c AS (SELECT unnest(list_filter([CASE WHEN contains(x, 'rand(') AND NOT contains(b, 'rand(') THEN 'introduced_rand' END, CASE WHEN contains(x, 'srand(') AND NOT contains(b, 'srand(') THEN 'introduced_srand' END,
  CASE WHEN regexp_matches(x, 'while ?\\(1\\)') AND NOT regexp_matches(b, 'while ?\\(1\\)') THEN 'introduced_while_true' END, CASE WHEN length(x) > length(b) * 1.25 AND length(b) > 0 THEN 'longer_code' END, CASE WHEN length(x) < length(b) * 0.75 THEN 'shorter_code' END], lambda y: y IS NOT NULL)) AS change FROM s WHERE b IS NOT NULL)
SELECT change, count(*) AS n FROM c GROUP BY change""")
def style_change_counts(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(ANSWER).alias("x"))
    a = a.withColumn("b", F.lag("x").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    changes = reviews.style_changes(R.style(F.col("b")), R.style(F.col("x")))
    return a.select(F.explode(changes).alias("change")).groupBy("change").agg(F.count("*").alias("n"))


@query(f"""{EVAL_SQL}, d AS (SELECT topic, CASE WHEN accepted THEN 'adapter' ELSE 'base' END AS selected, CASE WHEN accepted THEN model ELSE 'base' END AS adapter FROM r)
SELECT 'selected' AS kind, NULL AS topic, selected AS name, count(*) AS n FROM d GROUP BY selected UNION ALL SELECT 'topic', topic, NULL, count(*) FROM d GROUP BY topic UNION ALL SELECT 'topic_selected', topic, selected, count(*) FROM d GROUP BY topic, selected
UNION ALL SELECT 'adapter', NULL, adapter, count(*) FROM d GROUP BY adapter""")
def routing_counts(spark, sf_dir):
    r = eval_results(spark, sf_dir)
    ok = F.coalesce("accepted", F.lit(False))
    return reviews.routing_counts(r.select("topic", F.when(ok, "adapter").otherwise("base").alias("selected"), F.when(ok, F.col("model")).alias("adapter")))


@query("""SELECT count(*) AS candidates, count(*) FILTER (s_suppkey % 4 <> 0) AS approved, count(*) FILTER (s_suppkey % 4 <> 0 AND s_nationkey > 10) AS human_verified, count(*) FILTER (s_suppkey % 4 = 0) AS rejected, 'partial' AS verdict FROM supplier""")
def promotion_counts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 4 == 0, "rejected").otherwise("approved").alias("status"), F.when(F.col("s_nationkey") > 10, "human_verified").alias("tier"))
    return reviews.promotion_summary(s)


@query("SELECT id, prompt, solution FROM (SELECT doc_id % 300 AS id, text AS prompt, source AS solution, lang = 'en' AS accepted FROM documents) WHERE accepted AND prompt <> '' AND solution <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY prompt, solution) = 1")
def harvested_solutions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("id"), F.col("text").alias("prompt"), F.col("source").alias("solution"), (F.col("lang") == "en").alias("accepted"))
    return reviews.harvested(d).drop("accepted")


@query("SELECT event_id, array_to_string(list_filter(['event_type', 'k', 'zone'], lambda f: NOT list_contains(json_keys(props) || CASE WHEN event_id % 2 = 0 THEN ['zone'] ELSE [] END, f)), ',') AS missing FROM events")
def missing_fields(spark, sf_dir):
    present = F.concat(F.json_object_keys("props"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("zone"))).otherwise(F.array().cast("array<string>")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(reviews.missing_fields(("event_type", "k", "zone"), present), ",").alias("missing"))
