"""Verdicts and gates: labels and reasons from rows of deltas or metrics. Each is one projection or one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metrics that two runs are compared by, and whether more is better.
DIRECTIONS = {"accepted": 1, "avg_score": 1, "compile_rate": 1, "runtime_rate": 1, "semantic_rate": 1, "keyword_rate": 1, "timeout_rate": -1}
#: Thresholds of the adapter policy.
ADAPTER = {"collapse": -0.5, "task_reject": -20, "task_large": -5, "flat": 0.5}
#: Weights and thresholds of the model policy.
MODEL = {"strict": 0.6, "generated": 0.4, "material": 3.0, "negligible": 0.5, "score_drop": 0.5, "rate_drop": 0.0}
#: Thresholds of the dataset gate and of readiness.
DATASET = {"rejected": 0.25, "min_score": 50, "solutions": 0.9, "benchmark": 0.7, "top_solutions": 0.95, "top_benchmark": 0.8, "top_score": 75, "topic": 0.7}
READY_SCORE = 80.0
#: Order in which a decision is the headline, the first the strongest.
HEADLINE = ("invalid_model_override", "promote_default", "manual_review", "candidate", "safe_no_change", "reject")


def _said(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(x, name) for name, x in rules]))


def golden_verdict(tolerance: float = 1.0) -> Column:
    """A run against a locked one (columns golden_...): improvement is looked for before regression, and hides it."""
    c, g = F.col, lambda x: F.col(f"golden_{x}")
    better = (c("accepted") > g("accepted")) | (c("avg_score") > g("avg_score") + tolerance)
    worse = (c("accepted") < g("accepted")) | (c("avg_score") < g("avg_score") - tolerance) | (c("timeout_rate") > g("timeout_rate"))
    return F.when(better, "improvement").when(worse, "regression").otherwise("matches_golden")


def metric_changes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per pair and metric: base, new, delta, change (improvement, regression, no_change, or unavailable where
    a side is missing). pairs: keys, and base_ and new_ columns of each metric of DIRECTIONS."""
    one = lambda m, sign: F.struct(F.lit(m).alias("metric"), F.lit(sign).alias("sign"), F.col(f"base_{m}").cast("double").alias("base"), F.col(f"new_{m}").cast("double").alias("new"))
    rows = pairs.select(*keys, F.explode(F.array(*[one(m, s) for m, s in DIRECTIONS.items()])).alias("x")).select(*keys, "x.*")
    delta = F.bround(F.col("new") - F.col("base"), 6)
    up = F.col("sign") * delta
    change = F.when(delta.isNull(), "unavailable").when(F.abs(delta) <= 1e-9, "no_change").when(up > 0, "improvement").otherwise("regression")
    return rows.select(*keys, "metric", "base", "new", delta.alias("delta"), change.alias("change"))


def pair_verdicts(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair: the metrics of each change and the verdict; any regression wins over improvements."""
    named = lambda change: F.array_join(F.array_sort(F.collect_list(F.when(F.col("change") == change, F.col("metric")))), ",")
    out = changes.groupBy(*keys).agg(named("improvement").alias("improved"), named("regression").alias("regressed"), named("unavailable").alias("unavailable"))
    return out.withColumn("verdict", F.when(F.col("regressed") != "", "regression").when(F.col("improved") != "", "improvement").otherwise("no_change"))


def adapter_status() -> Column:
    """reject, promote, safe_no_change or ablation_only from a row of deltas with min_task_delta (0 without tasks)."""
    c = F.col
    low = F.coalesce("min_task_delta", F.lit(0))
    held = (c("accepted_delta") >= 0) & (c("compile_delta") >= 0) & (c("semantic_delta") >= 0)
    safe = held & (c("runtime_delta") >= 0) & (low >= ADAPTER["task_large"])
    bad = ~held | (c("runtime_delta") <= ADAPTER["collapse"]) | (low < ADAPTER["task_reject"])
    part = (c("avg_delta") < -ADAPTER["flat"]) | (c("runtime_delta") < 0) | (low < ADAPTER["task_large"])
    return F.when(bad, "reject").when(safe & (c("avg_delta") > 0), "promote").when(safe & (F.abs("avg_delta") <= ADAPTER["flat"]), "safe_no_change").when(held & part, "ablation_only").otherwise("reject")


def guarded(status: Column, verdict: Column) -> Column:
    """A status after the regression guard, which only ever lowers: a regression rejects, mixed signs leave an ablation."""
    open_ = status.isin("promote", "safe_no_change")
    return F.when(open_ & (verdict == "regression"), "reject").when(open_ & (verdict == "manual_review"), "ablation_only").otherwise(status)


def benchmark_state(tolerance: float = 1.0) -> Column:
    """regression, improvement or no_change of one benchmark from a row of deltas."""
    c = F.col
    worse = (c("accepted_delta") < 0) | (c("avg_delta") < -tolerance) | (c("runtime_delta") < 0) | (c("compile_delta") < 0) | (c("semantic_delta") < 0)
    better = (c("accepted_delta") > 0) | (c("avg_delta") > tolerance) | (c("runtime_delta") > 0)
    return F.when(worse, "regression").when(better, "improvement").otherwise("no_change")


def combined_status(strict: Column, generated: Column, extra_regressed: Column | None = None) -> Column:
    """What two benchmarks' states say together; a regression of any further benchmark forces a regression."""
    both = (
        F.when((generated == "improvement") & (strict != "regression"), "safe_generalization")
        .when(generated == "improvement", "synthetic_overfit")
        .when((strict == "regression") | (generated == "regression"), "regression")
        .otherwise("no_effect")
    )
    return both if extra_regressed is None else F.when(extra_regressed, "regression").otherwise(both)


def benchmark_role(name: Column) -> Column:
    """strict or generated by what the name holds, else other."""
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("strict")), "strict").when(F.contains(low, F.lit("generated")), "generated").otherwise("other")


def _regressed(p: str) -> Column:
    d = lambda x: F.col(f"{p}_{x}_delta")
    rates = [d(x) < -MODEL["rate_drop"] for x in ("compile", "runtime", "semantic")]
    return (d("avg") < -MODEL["score_drop"]) | (d("accepted") < 0) | rates[0] | rates[1] | rates[2]


def _improved(p: str) -> Column:
    return (F.col(f"{p}_avg_delta") >= MODEL["material"]) & (F.col(f"{p}_accepted_delta") >= 0)


def model_decisions(pairs: DataFrame) -> DataFrame:
    """pairs with weighted and decision. pairs: strict_ and generated_ deltas (avg, accepted, compile, runtime, semantic),
    null where a benchmark isn't complete, and override_valid."""
    weighted = F.bround(MODEL["strict"] * F.col("strict_avg_delta") + MODEL["generated"] * F.col("generated_avg_delta"), 3)
    s, g, w = _regressed("strict"), _regressed("generated"), F.col("weighted")
    decision = (
        F.when(~F.coalesce("override_valid", F.lit(False)), "invalid_model_override")
        .when(w.isNull(), "manual_review")
        .when((s & _improved("generated")) | (g & _improved("strict")), "manual_review")
        .when((s & g) | (w <= -MODEL["material"]), "reject")
        .when((w >= MODEL["material"]) & ~s & ~g, "promote_default")
        .when((F.abs(w) <= MODEL["negligible"]) & ~s & ~g, "safe_no_change")
        .otherwise("candidate")
    )
    return pairs.withColumn("weighted", weighted).withColumn("decision", decision)


def headline(decisions: DataFrame, by: str, seq: str) -> DataFrame:
    """The strongest decision of each group, by HEADLINE, then by weight (a missing one is the least); the first of equals."""
    rank = F.array_position(F.array(*map(F.lit, HEADLINE)), F.col("decision"))
    order = F.struct(F.when(rank == 0, len(HEADLINE) + 1).otherwise(rank).alias("r"), (-F.coalesce("weighted", F.lit(-1e9))).alias("w"), F.col(seq).alias("s"))
    return decisions.groupBy(by).agg(*[F.min_by(c, order).alias(c) for c in decisions.columns if c != by])


def dataset_gate() -> Column:
    """Status of a generated dataset from its counts and rates: records, verified_min (least verified count),
    rejected, solution_rate, benchmark_rate, avg_score, min_topic_rate, issues, isolated."""
    c, t = F.col, DATASET
    share = F.when(c("records") > 0, c("rejected") / c("records")).otherwise(0.0)
    unsure = (c("records") <= 0) | (c("verified_min") < c("records"))
    top = (c("solution_rate") >= t["top_solutions"]) & (c("rejected") == 0) & (c("benchmark_rate") >= t["top_benchmark"]) & (c("avg_score") >= t["top_score"]) & (c("min_topic_rate") >= t["topic"]) & c("isolated")
    return (
        F.when(unsure | (share > t["rejected"]) | (c("avg_score") < t["min_score"]), "reject")
        .when((c("solution_rate") < t["solutions"]) | (c("benchmark_rate") < t["benchmark"]) | (c("issues") > 0), "needs_audit")
        .when(top, "promote_to_candidate_training")
        .otherwise("isolated_eval_only")
    )


def deploy_gate(checks: DataFrame, by: str) -> DataFrame:
    """Verdict per group over tri-state checks: a blocking check that is false or wasn't run (null) blocks, any other
    that isn't true warns. checks: by, check, ok, blocking."""
    bad = lambda x: F.array_join(F.array_sort(F.collect_list(F.when(x, F.col("check")))), ",")
    open_ = ~F.coalesce("ok", F.lit(False))
    out = checks.groupBy(by).agg(bad(open_ & F.col("blocking")).alias("blocked_by"), bad(open_ & ~F.col("blocking")).alias("warnings"))
    return out.withColumn("verdict", F.when(F.col("blocked_by") != "", "blocked").when(F.col("warnings") != "", "ready_with_warnings").otherwise("ready"))


def readiness() -> Column:
    """Checks of a locked run that fail, in order; none means that it is ready."""
    c = F.col
    return _said(
        ("accepted_all", ~((c("accepted") == c("tasks")) & (c("tasks") > 0))),
        ("avg_score", ~(c("avg_score") >= READY_SCORE)),
        ("compile", ~(c("compile_rate") >= 1.0)),
        ("semantic", ~(c("semantic_rate") >= 1.0)),
        ("timeout", ~(c("timeout_rate") == 0.0)),
    )
