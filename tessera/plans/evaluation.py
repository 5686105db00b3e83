"""Queries over evaluation results: metrics, failures, comparisons of runs, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import compare, failures, metrics, verdicts
from tessera.plans.registry import query
from tessera.sources.tables import EVAL_SQL, eval_results, staged

_S = "coalesce(score, 0)"
_SUMMARY = f"count(*) AS n, count(*) FILTER (accepted) AS n_accepted, round_even(avg({_S}), 1) AS avg_score"


def _rate(c: str) -> str:
    return f"round_even(avg(coalesce({c}, false)::INT), 3)"


_METRICS = f"""{_SUMMARY}, min({_S}) AS min_score, max({_S}) AS max_score, {", ".join(f"{_rate(c + '_passed')} AS {c}_rate" for c in metrics.CHECKS)},
  {_rate("accepted")} AS accepted_rate, {_rate("timed_out")} AS timeout_rate,
  count(*) FILTER ({_S} >= 90) AS n_90_100, count(*) FILTER ({_S} BETWEEN 70 AND 89) AS n_70_89, count(*) FILTER ({_S} BETWEEN 60 AND 69) AS n_60_69, count(*) FILTER ({_S} < 60) AS n_0_59,
  coalesce(round_even(avg(latency_ms) FILTER (latency_ms > 0), 0), 0)::BIGINT AS latency_avg, coalesce(min(latency_ms) FILTER (latency_ms > 0), 0) AS latency_min, coalesce(max(latency_ms) FILTER (latency_ms > 0), 0) AS latency_max"""
_SHARES = ", ".join(f"avg(coalesce({c}, false)::INT) AS {n}_rate" for c, n in [*((f"{x}_passed", x) for x in compare.RATES), ("timed_out", "timeout")])
_RUNS = f"""{EVAL_SQL},
u AS (SELECT model, run_id, min(stamp) AS stamp, count(*) AS tasks, count(*) FILTER (accepted) AS accepted, avg({_S}) AS avg_score, {_SHARES} FROM r GROUP BY ALL),
p AS (SELECT *, (SELECT arg_max(b.run_id, b.stamp || b.run_id) FROM u b WHERE b.model = u.model AND b.stamp < u.stamp) AS previous_run FROM u)"""
_SIDES = f"""{_RUNS},
b AS (SELECT p.run_id AS to_run, previous_run, r.id, topic, {_S} AS score, coalesce(r.accepted, false) AS ok FROM r JOIN p ON r.run_id = p.previous_run),
n AS (SELECT p.run_id AS to_run, previous_run, r.id, topic, {_S} AS score, coalesce(r.accepted, false) AS ok FROM r JOIN p ON r.run_id = p.run_id WHERE previous_run IS NOT NULL),
j AS (SELECT to_run, id, coalesce(b.score, 0) AS base_score, coalesce(n.score, 0) AS new_score, coalesce(b.ok, false) AS base_ok, coalesce(n.ok, false) AS new_ok, b.id IS NOT NULL AND n.id IS NOT NULL AS common FROM b FULL JOIN n USING (to_run, id))"""
_DELTAS = f"""{_SIDES},
t AS (SELECT to_run, count(*) FILTER (base_ok AND NOT new_ok) AS newly_broken, count(*) FILTER (common AND new_score - base_score < -20) AS big_drops, min(new_score - base_score) FILTER (common) AS largest_drop FROM j GROUP BY to_run),
d AS (SELECT p.model, p.run_id, p.previous_run, p.accepted - o.accepted AS accepted_delta, round_even(p.avg_score - o.avg_score, 1) + 0::DOUBLE AS avg_delta,
  {", ".join(f"round_even(p.{c}_rate - o.{c}_rate, 3) + 0::DOUBLE AS {c}_delta" for c in (*compare.RATES, "timeout"))}, coalesce(newly_broken, 0) AS newly_broken, coalesce(big_drops, 0) AS big_drops, largest_drop
  FROM p LEFT JOIN u o ON o.run_id = p.previous_run LEFT JOIN t ON to_run = p.run_id)"""
_VERDICT = """
w AS (SELECT *, list_filter([CASE WHEN accepted_delta < 0 THEN 'accepted' END, CASE WHEN avg_delta < -1 THEN 'avg_score' END, CASE WHEN compile_delta < 0 THEN 'compile_rate' END, CASE WHEN runtime_delta < 0 THEN 'runtime_rate' END,
  CASE WHEN newly_broken > 0 THEN 'newly_broken' END, CASE WHEN big_drops > 0 THEN 'task_drop' END], lambda x: x IS NOT NULL) AS worse,
  list_filter([CASE WHEN newly_broken = 0 AND accepted_delta > 0 THEN '+accepted' END, CASE WHEN newly_broken = 0 AND avg_delta >= 1 THEN '+avg_score' END], lambda x: x IS NOT NULL) AS better FROM d),
v AS (SELECT * EXCLUDE (worse, better), CASE WHEN previous_run IS NULL THEN 'no_reference' WHEN len(worse) > 0 AND len(better) > 0 THEN 'manual_review' WHEN len(worse) > 0 THEN 'regression' WHEN len(better) > 0 THEN 'improvement' ELSE 'pass' END AS verdict,
  CASE WHEN previous_run IS NULL THEN '' ELSE array_to_string(worse || better, ',') END AS reasons FROM w)"""


@query(f"{EVAL_SQL} SELECT topic, {_METRICS} FROM r GROUP BY topic")
def run_metrics_by_topic(spark, sf_dir):
    return metrics.run_metrics(eval_results(spark, sf_dir), "topic")


@query(f"{EVAL_SQL} SELECT run_id, {_METRICS} FROM r GROUP BY run_id")
def run_metrics_by_run(spark, sf_dir):
    return metrics.run_metrics(eval_results(spark, sf_dir), "run_id")


@query(f"{EVAL_SQL} SELECT run_id, topic, difficulty, {_SUMMARY} FROM r GROUP BY GROUPING SETS ((run_id, topic), (run_id, difficulty), (run_id))")
def topic_and_difficulty(spark, sf_dir):
    return metrics.topic_and_difficulty(eval_results(spark, sf_dir), "run_id")


_TABLE = ["n", "n_accepted", "avg_score", *[f"{c}_rate" for c in metrics.CHECKS], "accepted_rate", "timeout_rate"]


@query(f"""{EVAL_SQL}, m AS (SELECT run_id, {_METRICS} FROM r GROUP BY run_id) SELECT run_id, x.metric AS metric, x.value AS value FROM
(SELECT run_id, unnest([{", ".join(f"{{'metric': '{c}', 'value': {c}::DOUBLE}}" for c in _TABLE)}]) AS x FROM m)""")
def metric_table(spark, sf_dir):
    return metrics.metric_table(eval_results(spark, sf_dir))


@query(f"""{EVAL_SQL} SELECT run_id, bucket, (SELECT count(*) FROM r WHERE r.run_id = x.run_id AND {_S} BETWEEN lo AND hi) AS n
FROM (SELECT DISTINCT run_id FROM r) x, (VALUES ('90-100', 90, 1000), ('70-89', 70, 89), ('60-69', 60, 69), ('0-59', 0, 59)) b(bucket, lo, hi)""")
def score_histogram(spark, sf_dir):
    return metrics.score_histogram(eval_results(spark, sf_dir), "run_id")


@query(f"""{EVAL_SQL} SELECT topic, {_SUMMARY}, count(*) FILTER ({_S} < 60) AS n_low, count(*) FILTER (compile_passed = false) AS n_compile_failed, count(*) FILTER (runtime_passed = false) AS n_runtime_failed
FROM r GROUP BY topic HAVING count(*) FILTER (accepted) < 0.8 * count(*) OR min({_S}) < 60 OR count(*) FILTER (compile_passed = false OR runtime_passed = false) > 0""")
def weak_topics(spark, sf_dir):
    return metrics.weak_topics(eval_results(spark, sf_dir))


@query(f"{EVAL_SQL} SELECT run_id, round_even(min(rate), 3) AS min_acceptance FROM (SELECT run_id, topic, avg(coalesce(accepted, false)::INT) AS rate FROM r GROUP BY ALL) GROUP BY run_id")
def min_topic_acceptance(spark, sf_dir):
    return metrics.min_topic_acceptance(eval_results(spark, sf_dir), "run_id")


@query(f"{EVAL_SQL} SELECT model, sum(tasks)::BIGINT AS tasks, round_even(sum(a * tasks) / sum(tasks), 2) AS avg_score FROM (SELECT model, run_id, count(*) AS tasks, round_even(avg({_S}), 2) AS a FROM r GROUP BY ALL) GROUP BY model")
def weighted_mean(spark, sf_dir):
    return metrics.weighted_mean(eval_results(spark, sf_dir))


@query(f"{EVAL_SQL} SELECT model, id, count(*) AS runs, max({_S}) - min({_S}) AS score_range FROM r GROUP BY model, id HAVING count(*) >= 2 AND max({_S}) - min({_S}) > 5")
def flaky_tasks(spark, sf_dir):
    return metrics.flaky_tasks(eval_results(spark, sf_dir))


@query(f"""{EVAL_SQL}, c AS (SELECT run_id, model, year, max(year IS NOT NULL)::INT AS y, max(accepted IS NOT NULL)::INT AS a FROM r GROUP BY ALL),
g AS (SELECT model, year FROM c GROUP BY ALL HAVING count(*) >= 2),
f AS (SELECT r.model, r.year, id FROM r JOIN g ON r.model = g.model AND r.year IS NOT DISTINCT FROM g.year GROUP BY ALL HAVING count(*) >= 2 AND max({_S}) - min({_S}) > 0)
SELECT total_runs, stamp_rate, groups_checked, flaky_tasks, CASE WHEN flaky_tasks > 0 THEN 'flaky' WHEN stamp_rate < 1 THEN 'unstamped' ELSE 'reliable' END AS verdict
FROM (SELECT count(*) AS total_runs, round_even(avg((y + a = 2)::INT), 3) AS stamp_rate FROM c), (SELECT count(*) AS groups_checked FROM g), (SELECT count(*) AS flaky_tasks FROM f)""")
def reliability(spark, sf_dir):
    return metrics.reliability(eval_results(spark, sf_dir), ["model", "year"], ["year", "accepted"])


_LABELS = """l AS (SELECT *, list_filter([CASE WHEN NOT proxy_passed THEN 'partial_generation' END, CASE WHEN NOT coalesce(truncation_passed, true) THEN 'truncation' END, CASE WHEN NOT has_main THEN 'missing_entrypoint' END], lambda x: x IS NOT NULL) AS s,
  list_filter([CASE WHEN contains(lower(compile_error), 'undeclared') THEN 'hallucinated_function' END, CASE WHEN regexp_matches(lower(compile_error), 'array|subscript|index') THEN 'array_bounds' END, CASE WHEN regexp_matches(lower(compile_error), 'stray|error: expected') THEN 'syntax_error' END], lambda x: x IS NOT NULL) AS c
  FROM r WHERE NOT coalesce(accepted, false)),
m AS (SELECT *, CASE WHEN compile_passed = false THEN CASE WHEN len(s || c) = 0 OR (s || c) IN (['partial_generation'], ['truncation']) THEN s || c || ['syntax_error'] ELSE s || c END
  WHEN compile_passed AND runtime_passed = false THEN s || [CASE WHEN match_ratio > 0.5 AND match_ratio < 1 THEN 'io_format_error' WHEN match_ratio > 0 AND match_ratio < 1 THEN 'logic_error' WHEN regexp_matches(topic, 'geometry|distance|nearest|point|triangle') THEN 'geometry_reasoning' ELSE 'algorithm_mismatch' END] ELSE s END AS k FROM l),
x AS (SELECT *, CASE WHEN len(k) = 0 THEN ['runtime_error'] ELSE k END AS labels FROM m),
y AS (SELECT *, list_filter(['syntax_error', 'runtime_error', 'truncation', 'logic_error', 'missing_entrypoint', 'partial_generation', 'hallucinated_function', 'algorithm_mismatch', 'geometry_reasoning', 'array_bounds', 'io_format_error'], lambda x: list_contains(labels, x))[1] AS first FROM x)"""


@query(f"{EVAL_SQL}, {_LABELS} SELECT run_id, id, array_to_string(labels, ',') AS labels, first AS primary_label FROM y")
def failure_labels(spark, sf_dir):
    rows = failures.classified(eval_results(spark, sf_dir))
    return rows.select("run_id", "id", F.array_join("labels", ",").alias("labels"), F.col("primary").alias("primary_label"))


@query(f"""{EVAL_SQL}, {_LABELS} SELECT view, key, count(*) AS n FROM (
SELECT 'primary' AS view, first AS key FROM y UNION ALL SELECT 'label', unnest(labels) FROM y UNION ALL SELECT 'topic', topic FROM y UNION ALL SELECT 'model', model FROM y
UNION ALL SELECT 'year', coalesce(year::VARCHAR, 'unknown') FROM y UNION ALL SELECT 'topic_primary', topic || '/' || first FROM y) GROUP BY ALL""")
def failure_mining(spark, sf_dir):
    return failures.mined(eval_results(spark, sf_dir))


@query(f"{EVAL_SQL}, {_LABELS} SELECT run_id, id, CASE first {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in failures.HINTS.items())} END AS hint FROM y")
def failure_hints(spark, sf_dir):
    rows = failures.classified(eval_results(spark, sf_dir))
    return rows.select("run_id", "id", failures.hint(F.col("primary")).alias("hint"))


@query(f"""{_SIDES} SELECT to_run, id, base_score, new_score, CASE WHEN base_ok AND NOT new_ok THEN 'newly_broken' WHEN NOT base_ok AND new_ok THEN 'newly_fixed' WHEN base_ok THEN 'unchanged_pass' ELSE 'unchanged_fail' END AS change FROM j""")
def run_diff(spark, sf_dir):
    return compare.run_diff(*compare.against_previous(eval_results(spark, sf_dir)), ("to_run", "id"))


@query(f"{_SIDES} SELECT to_run, id, base_score, new_score, new_score - base_score AS delta FROM j WHERE common")
def task_deltas(spark, sf_dir):
    return compare.task_deltas(*compare.against_previous(eval_results(spark, sf_dir)), ("to_run", "id")).drop("base_ok", "new_ok")


@query(f"{_SIDES} SELECT to_run, id, base_score, new_score, new_score - base_score AS delta FROM j")
def adapter_task_deltas(spark, sf_dir):
    return compare.task_deltas(*compare.against_previous(eval_results(spark, sf_dir)), ("to_run", "id"), "full_outer").drop("base_ok", "new_ok")


@query(f"""{_SIDES}, x AS (SELECT j.*, topic, new_score - base_score AS delta FROM j JOIN n USING (to_run, id) WHERE common)
SELECT topic, count(*) AS tasks, round_even(avg(delta), 3) + 0::DOUBLE AS avg_delta, sum(new_ok::INT - base_ok::INT)::BIGINT AS accepted_delta, count(*) FILTER (delta < 0) AS regressions,
arg_min(to_run || '/' || id, (delta, to_run || '/' || id)) AS worst_id, min(delta) AS worst_delta FROM x GROUP BY topic""")
def delta_by_topic(spark, sf_dir):
    base, new = compare.against_previous(eval_results(spark, sf_dir))
    pairs = compare.task_deltas(base, new, ("to_run", "id")).join(new.select("to_run", "id", "topic"), ["to_run", "id"])
    return metrics.delta_groups(pairs.withColumn("id", F.concat_ws("/", "to_run", "id")), "topic")


@query(f"{_DELTAS}, {_VERDICT} SELECT * FROM v")
def regression_verdicts(spark, sf_dir):
    return compare.regressions(staged(eval_results(spark, sf_dir)))


@query(f"{_RUNS} SELECT model, run_id, previous_run FROM p")
def previous_run(spark, sf_dir):
    return compare.previous_run(compare.runs_of(eval_results(spark, sf_dir))).select("model", "run_id", "previous_run")


@query(f"""{_RUNS}, t AS (SELECT model, count(*) AS run_count, arg_min(run_id, stamp || run_id) AS first_run, arg_max(run_id, stamp || run_id) AS latest_run, arg_min(round_even(avg_score, 1), stamp || run_id) AS first_avg, arg_max(round_even(avg_score, 1), stamp || run_id) AS latest_avg FROM u GROUP BY model)
SELECT *, CASE WHEN run_count < 2 THEN 'insufficient_history' WHEN latest_avg - first_avg > 1 THEN 'improving' WHEN latest_avg - first_avg < -1 THEN 'declining' ELSE 'flat' END AS trend FROM t""")
def model_trend(spark, sf_dir):
    return compare.trend(compare.runs_of(eval_results(spark, sf_dir)))


@query(f"{_RUNS} SELECT model, string_agg(run_id || ':' || accepted, ',' ORDER BY stamp, run_id) AS runs FROM u GROUP BY model")
def model_series(spark, sf_dir):
    s = compare.series(compare.runs_of(eval_results(spark, sf_dir)))
    return s.select("model", F.array_join(F.transform("runs", lambda x: F.concat_ws(":", x["run_id"], x["accepted"].cast("string"))), ",").alias("runs"))


@query(f"{_RUNS} SELECT model, run_id, row_number() OVER (PARTITION BY model ORDER BY stamp DESC, run_id DESC) AS n FROM u QUALIFY n <= 2")
def latest_two_runs(spark, sf_dir):
    return compare.latest_two(compare.runs_of(eval_results(spark, sf_dir)))


@query(f"{_RUNS} SELECT row_number() OVER (ORDER BY round_even(avg_score, 1) DESC, accepted DESC, stamp DESC, run_id DESC) AS rank, run_id, model, round_even(avg_score, 1) AS avg_score, accepted FROM u QUALIFY rank <= 10")
def leaderboard(spark, sf_dir):
    return compare.leaderboard(compare.runs_of(eval_results(spark, sf_dir)))


@query(f"""{_RUNS}, g AS (SELECT model, accepted AS ga, avg_score AS gs, timeout_rate AS gt FROM u QUALIFY row_number() OVER (PARTITION BY model ORDER BY stamp, run_id) = 1)
SELECT run_id, CASE WHEN accepted > ga OR avg_score > gs + 1 THEN 'improvement' WHEN accepted < ga OR avg_score < gs - 1 OR timeout_rate > gt THEN 'regression' ELSE 'matches_golden' END AS verdict FROM u JOIN g USING (model)""")
def golden_verdicts(spark, sf_dir):
    runs = compare.runs_of(eval_results(spark, sf_dir))
    first = F.min(F.struct("stamp", "run_id", "accepted", "avg_score", "timeout_rate")).alias("g")
    golden = runs.groupBy("model").agg(first).select("model", *[F.col(f"g.{c}").alias(f"golden_{c}") for c in ("accepted", "avg_score", "timeout_rate")])
    return runs.join(golden, "model").select("run_id", verdicts.golden_verdict().alias("verdict"))


def _pairs(spark, sf_dir):
    runs = compare.previous_run(compare.runs_of(eval_results(spark, sf_dir)))
    side = lambda p: [F.col(m).alias(f"{p}_{m}") for m in verdicts.DIRECTIONS]
    return runs.select("run_id", "previous_run", *side("new")).join(runs.select(F.col("run_id").alias("previous_run"), *side("base")), "previous_run", "left").drop("previous_run")


_CHANGES = f"""{_RUNS}, c AS (SELECT p.run_id, unnest([{", ".join(f"{{'metric': '{m}', 'sign': {s}, 'base': o.{m}::DOUBLE, 'new': p.{m}::DOUBLE}}" for m, s in verdicts.DIRECTIONS.items())}]) AS x FROM p LEFT JOIN u o ON o.run_id = p.previous_run),
e AS (SELECT run_id, x.metric AS metric, x.base AS base, x.new AS new, round_even(x.new - x.base, 6) + 0::DOUBLE AS delta, x.sign AS sign FROM c),
f AS (SELECT run_id, metric, base, new, delta, CASE WHEN delta IS NULL THEN 'unavailable' WHEN abs(delta) <= 1e-9 THEN 'no_change' WHEN sign * delta > 0 THEN 'improvement' ELSE 'regression' END AS change FROM e)"""


@query(f"{_CHANGES} SELECT * FROM f")
def metric_changes(spark, sf_dir):
    return verdicts.metric_changes(_pairs(spark, sf_dir), ["run_id"])


@query(f"""{_CHANGES}, g AS (SELECT run_id, {", ".join(f"coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (change = '{k}'), '') AS {n}" for k, n in (("improvement", "improved"), ("regression", "regressed"), ("unavailable", "unavailable")))} FROM f GROUP BY run_id)
SELECT *, CASE WHEN regressed <> '' THEN 'regression' WHEN improved <> '' THEN 'improvement' ELSE 'no_change' END AS verdict FROM g""")
def run_pair_verdicts(spark, sf_dir):
    return verdicts.pair_verdicts(verdicts.metric_changes(_pairs(spark, sf_dir), ["run_id"]), ["run_id"])


_ADAPTER = """a AS (SELECT *, coalesce(largest_drop, 0) AS low, accepted_delta >= 0 AND compile_delta >= 0 AND semantic_delta >= 0 AS held FROM v WHERE previous_run IS NOT NULL),
b2 AS (SELECT run_id, verdict, CASE WHEN NOT held OR runtime_delta <= -0.5 OR low < -20 THEN 'reject' WHEN runtime_delta >= 0 AND low >= -5 AND avg_delta > 0 THEN 'promote'
  WHEN runtime_delta >= 0 AND low >= -5 AND abs(avg_delta) <= 0.5 THEN 'safe_no_change' WHEN avg_delta < -0.5 OR runtime_delta < 0 OR low < -5 THEN 'ablation_only' ELSE 'reject' END AS status FROM a)"""


@query(f"{_DELTAS}, {_VERDICT}, {_ADAPTER} SELECT run_id, status, CASE WHEN status IN ('promote', 'safe_no_change') AND verdict = 'regression' THEN 'reject' WHEN status IN ('promote', 'safe_no_change') AND verdict = 'manual_review' THEN 'ablation_only' ELSE status END AS guarded FROM b2")
def adapter_decisions(spark, sf_dir):
    d = compare.regressions(staged(eval_results(spark, sf_dir))).where("previous_run IS NOT NULL").withColumn("min_task_delta", F.col("largest_drop"))
    d = d.withColumn("status", verdicts.adapter_status())
    return d.select("run_id", "status", verdicts.guarded(F.col("status"), F.col("verdict")).alias("guarded"))


def _by_benchmark(spark, sf_dir):
    """Deltas of every model against m0, per benchmark role, side by side."""
    r = eval_results(spark, sf_dir).withColumn("role", verdicts.benchmark_role(F.col("benchmark")))
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    agg = r.groupBy("role", "model").agg(F.count_if("accepted").alias("accepted"), F.bround(F.avg(F.coalesce("score", F.lit(0))), 2).alias("avg"), *[share(f"{c}_passed").alias(c) for c in ("compile", "runtime", "semantic")], F.bool_and("proxy_passed").alias("ok"))
    names = ("accepted", "avg", "compile", "runtime", "semantic")
    base = agg.where("model = 'm0'").select("role", *[F.col(c).alias(f"b_{c}") for c in names])
    d = agg.where("model <> 'm0'").join(base, "role").select("model", "role", *[F.bround(F.col(c) - F.col(f"b_{c}"), 3).alias(f"{c}_delta") for c in names])
    two = lambda role: d.where(F.col("role") == role).select("model", *[F.col(f"{c}_delta").alias(f"{role}_{c}_delta") for c in names])
    return two("strict").join(two("generated"), "model", "full_outer")


_ROLES = f"""{EVAL_SQL}, g AS (SELECT CASE WHEN contains(benchmark, 'strict') THEN 'strict' ELSE 'generated' END AS role, model, count(*) FILTER (accepted) AS accepted, round_even(avg({_S}), 2) AS avg,
  {", ".join(f"avg(coalesce({c}_passed, false)::INT) AS {c}" for c in ("compile", "runtime", "semantic"))} FROM r GROUP BY ALL),
e AS (SELECT x.model, x.role, {", ".join(f"round_even(x.{c} - y.{c}, 3) + 0::DOUBLE AS {c}" for c in ("accepted", "avg", "compile", "runtime", "semantic"))} FROM g x JOIN g y ON x.role = y.role AND y.model = 'm0' WHERE x.model <> 'm0'),
q AS (SELECT *, avg < -0.5 OR accepted < 0 OR compile < 0 OR runtime < 0 OR semantic < 0 AS regressed, avg >= 3 AND accepted >= 0 AS improved,
  CASE WHEN accepted < 0 OR avg < -1 OR runtime < 0 OR compile < 0 OR semantic < 0 THEN 'regression' WHEN accepted > 0 OR avg > 1 OR runtime > 0 THEN 'improvement' ELSE 'no_change' END AS state FROM e),
k AS (SELECT s.model, s.avg AS sa, t.avg AS ta, s.regressed AS sr, t.regressed AS tr, s.improved AS si, t.improved AS ti, s.state AS ss, t.state AS ts, round_even(0.6 * s.avg + 0.4 * t.avg, 3) + 0::DOUBLE AS weighted FROM q s JOIN q t ON s.model = t.model AND s.role = 'strict' AND t.role = 'generated'),
m AS (SELECT *, CASE WHEN model = 'm2' THEN 'invalid_model_override' WHEN (sr AND ti) OR (tr AND si) THEN 'manual_review' WHEN (sr AND tr) OR weighted <= -3 THEN 'reject' WHEN weighted >= 3 AND NOT sr AND NOT tr THEN 'promote_default'
  WHEN abs(weighted) <= 0.5 AND NOT sr AND NOT tr THEN 'safe_no_change' ELSE 'candidate' END AS decision FROM k)"""


@query(f"{_ROLES} SELECT model, weighted, decision FROM m")
def model_decisions(spark, sf_dir):
    pairs = _by_benchmark(spark, sf_dir).withColumn("override_valid", F.col("model") != "m2")
    return verdicts.model_decisions(pairs).select("model", "weighted", "decision")


@query(f"{_ROLES} SELECT 'all' AS baseline, model, decision FROM m ORDER BY CASE decision WHEN 'invalid_model_override' THEN 0 WHEN 'promote_default' THEN 1 WHEN 'manual_review' THEN 2 WHEN 'candidate' THEN 3 WHEN 'safe_no_change' THEN 4 ELSE 5 END, weighted DESC, model LIMIT 1")
def headline_decision(spark, sf_dir):
    d = model_decisions(spark, sf_dir).withColumn("baseline", F.lit("all")).withColumn("seq", F.col("model"))
    return verdicts.headline(d, "baseline", "seq").select("baseline", "model", "decision")


@query(f"""{_ROLES} SELECT model, ss AS strict_state, ts AS generated_state, CASE WHEN ts = 'improvement' AND ss <> 'regression' THEN 'safe_generalization' WHEN ts = 'improvement' THEN 'synthetic_overfit' WHEN ss = 'regression' OR ts = 'regression' THEN 'regression' ELSE 'no_effect' END AS status FROM m""")
def benchmark_states(spark, sf_dir):
    pairs = _by_benchmark(spark, sf_dir)
    of = lambda p: pairs.select("model", *[F.col(f"{p}_{c}_delta").alias(f"{c}_delta") for c in ("accepted", "avg", "compile", "runtime", "semantic")]).select("model", verdicts.benchmark_state().alias(f"{p}_state"))
    both = of("strict").join(of("generated"), "model")
    return both.withColumn("status", verdicts.combined_status(F.col("strict_state"), F.col("generated_state")))


@query(f"""{EVAL_SQL}, t AS (SELECT model, topic, avg(coalesce(accepted, false)::INT) AS rate FROM r GROUP BY ALL), l AS (SELECT model, min(rate) AS low FROM t GROUP BY model),
g AS (SELECT model, count(*) AS n, least(count(*) FILTER (compile_passed IS NOT NULL), count(*) FILTER (runtime_passed IS NOT NULL)) AS seen, count(*) FILTER (accepted = false) AS rejected, avg(coalesce(accepted, false)::INT) AS rate, avg({_S}) AS score, count(*) FILTER (NOT has_main) AS issues FROM r WHERE compile_passed IS NOT NULL AND runtime_passed IS NOT NULL GROUP BY model)
SELECT model, CASE WHEN seen < n OR rejected / n > 0.25 OR score < 50 THEN 'reject' WHEN rate < 0.9 OR issues > 0 THEN 'needs_audit' WHEN rate >= 0.95 AND rejected = 0 AND score >= 75 AND low >= 0.7 THEN 'promote_to_candidate_training' ELSE 'isolated_eval_only' END AS status FROM g JOIN l USING (model)""")
def dataset_gates(spark, sf_dir):
    r = eval_results(spark, sf_dir)
    ok = F.avg(F.coalesce("accepted", F.lit(False)).cast("int"))
    low = r.groupBy("model", "topic").agg(ok.alias("rate")).groupBy("model").agg(F.min("rate").alias("min_topic_rate"))
    verified = F.least(F.count("compile_passed"), F.count("runtime_passed"))
    g = r.where("compile_passed IS NOT NULL AND runtime_passed IS NOT NULL").groupBy("model").agg(
        F.count("*").alias("records"), verified.alias("verified_min"), F.count_if(~F.col("accepted")).alias("rejected"), ok.alias("solution_rate"), ok.alias("benchmark_rate"),
        F.avg(F.coalesce("score", F.lit(0))).alias("avg_score"), F.count_if(~F.col("has_main")).alias("issues"), F.lit(True).alias("isolated"),
    )
    return g.join(low, "model").select("model", verdicts.dataset_gate().alias("status"))


_CHECKED = ("proxy", "truncation", "compile", "semantic")


@query(f"""{EVAL_SQL}, c AS (SELECT run_id, {", ".join(f"bool_and({c}_passed) AS {c}" for c in _CHECKED)} FROM r GROUP BY run_id), x AS (SELECT run_id, unnest([{", ".join(f"{{'c': '{c}', 'ok': {c}}}" for c in _CHECKED)}]) AS x FROM c),
g AS (SELECT run_id, coalesce(string_agg(x.c, ',' ORDER BY x.c) FILTER (NOT coalesce(x.ok, false) AND x.c IN ('compile', 'proxy')), '') AS blocked_by, coalesce(string_agg(x.c, ',' ORDER BY x.c) FILTER (NOT coalesce(x.ok, false) AND x.c NOT IN ('compile', 'proxy')), '') AS warnings FROM x GROUP BY run_id)
SELECT *, CASE WHEN blocked_by <> '' THEN 'blocked' WHEN warnings <> '' THEN 'ready_with_warnings' ELSE 'ready' END AS verdict FROM g""")
def deploy_gates(spark, sf_dir):
    r = eval_results(spark, sf_dir).groupBy("run_id").agg(*[F.bool_and(f"{c}_passed").alias(c) for c in _CHECKED])
    one = lambda c: F.struct(F.lit(c).alias("check"), F.col(c).alias("ok"), F.lit(c in ("compile", "proxy")).alias("blocking"))
    return verdicts.deploy_gate(r.select("run_id", F.explode(F.array(*map(one, _CHECKED))).alias("x")).select("run_id", "x.*"), "run_id")


@query(f"""{_RUNS} SELECT run_id, array_to_string(list_filter([CASE WHEN NOT (accepted = tasks AND tasks > 0) THEN 'accepted_all' END, CASE WHEN NOT avg_score >= 80 THEN 'avg_score' END, CASE WHEN NOT compile_rate >= 1 THEN 'compile' END,
CASE WHEN NOT semantic_rate >= 1 THEN 'semantic' END, CASE WHEN NOT timeout_rate = 0 THEN 'timeout' END], lambda x: x IS NOT NULL), ',') AS failed FROM u""")
def readiness(spark, sf_dir):
    return compare.runs_of(eval_results(spark, sf_dir)).select("run_id", F.array_join(verdicts.readiness(), ",").alias("failed"))
