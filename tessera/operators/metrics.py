"""Grouped metrics over evaluation results. Means are rounded half to even; a missing check counts as failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Score buckets and their least scores.
BUCKETS = (("90-100", 90), ("70-89", 70), ("60-69", 60), ("0-59", None))


def rate(passed: str, digits: int = 3) -> Column:
    return F.bround(F.avg(F.coalesce(F.col(passed), F.lit(False)).cast("int")), digits)


def summary() -> list[Column]:
    """Count, accepted and the rounded average score of a group."""
    return [
        F.count("*").alias("n"),
        F.count_if(F.coalesce("accepted", F.lit(False))).alias("n_accepted"),
        F.bround(F.avg(F.coalesce("score", F.lit(0))), 1).alias("avg_score"),
    ]


#: Checks whose pass rates a run's metrics have.
CHECKS = ("proxy", "truncation", "compile", "runtime", "semantic", "keyword")


def run_metrics(results: DataFrame, *by: str) -> DataFrame:
    """Metrics of each group: counts, scores (a missing one is 0), seven pass rates, score buckets, and latencies
    above zero (0 if there are none)."""
    took, score = F.when(F.col("latency_ms") > 0, F.col("latency_ms")), F.coalesce("score", F.lit(0))
    in_bucket = bucket(score)
    return results.groupBy(*by).agg(
        *summary(),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        *[rate(f"{c}_passed").alias(f"{c}_rate") for c in CHECKS],
        rate("accepted").alias("accepted_rate"),
        rate("timed_out").alias("timeout_rate"),
        *[F.count_if(in_bucket == name).alias("n_" + name.replace("-", "_")) for name, _ in BUCKETS],
        F.coalesce(F.bround(F.avg(took), 0), F.lit(0.0)).cast("bigint").alias("latency_avg"),
        F.coalesce(F.min(took), F.lit(0)).alias("latency_min"),
        F.coalesce(F.max(took), F.lit(0)).alias("latency_max"),
    )


def topic_and_difficulty(results: DataFrame, *by: str) -> DataFrame:
    """The summary by topic, by difficulty and over all (within each group of by), in one pass."""
    grouped = results.groupingSets([[*by, "topic"], [*by, "difficulty"], [*by]], *by, "topic", "difficulty")
    return grouped.agg(*summary())


def metric_table(results: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per metric of each run: metric, run, value. Long, so that any number of runs fits."""
    m = run_metrics(results, run)
    names = [c for c in m.columns if c.endswith("_rate") or c in ("avg_score", "n", "n_accepted")]
    return m.select(run, F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "value"))


def delta_groups(pairs: DataFrame, *by: str, tiny: float = 0.0) -> DataFrame:
    """Per group of task deltas: tasks, average delta, change of accepted tasks, regressions, and the task with the
    largest drop (the first id on a tie). pairs: id, delta, base_ok, new_ok."""
    ok = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    worst = F.min(F.struct("delta", "id"))
    return pairs.groupBy(*by).agg(
        F.count("*").alias("tasks"),
        F.bround(F.avg("delta"), 3).alias("avg_delta"),
        F.sum(ok("new_ok") - ok("base_ok")).alias("accepted_delta"),
        F.count_if(F.col("delta") < -tiny).alias("regressions"),
        worst["id"].alias("worst_id"),
        worst["delta"].alias("worst_delta"),
    )


def reliability(results: DataFrame, config: list[str], stamps: list[str], tolerance: float = 0.0, min_runs: int = 2) -> DataFrame:
    """One row: runs, share of runs with all stamps, configurations with enough runs, flaky tasks, verdict."""
    runs = results.groupBy("run_id", *config).agg(*[F.max(F.col(c).isNotNull().cast("int")).alias(f"_{c}") for c in stamps])
    stamped = sum((F.col(f"_{c}") for c in stamps), F.lit(0)) == len(stamps)
    audit = runs.agg(F.count("*").alias("total_runs"), F.bround(F.coalesce(F.avg(stamped.cast("int")), F.lit(0.0)), 3).alias("stamp_rate"))
    groups = runs.groupBy(*config).agg(F.count("*").alias("_runs")).where(F.col("_runs") >= min_runs)
    score = F.coalesce("score", F.lit(0))
    null_safe = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in config]
    tasks = results.alias("r").join(groups.alias("g"), null_safe).groupBy(*[F.col(f"r.{c}") for c in config], "id").agg(F.count("*").alias("_n"), (F.max(score) - F.min(score)).alias("spread"))
    flaky = tasks.agg(F.count_if((F.col("_n") >= 2) & (F.col("spread") > tolerance)).alias("flaky_tasks"))
    out = audit.join(groups.agg(F.count("*").alias("groups_checked"))).join(flaky)  # one row each
    verdict = F.when(F.col("flaky_tasks") > 0, "flaky").when(F.col("stamp_rate") < 1, "unstamped").otherwise("reliable")
    return out.withColumn("verdict", verdict)


def bucket(score: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, least in BUCKETS:
        out = out.when(score >= least, name) if least is not None else out.otherwise(name)
    return out


def score_histogram(results: DataFrame, by: str) -> DataFrame:
    """Rows in each bucket, zeros included."""
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("bucket"), F.lit(0).alias("one")) for n, _ in BUCKETS])).alias("b")
    zero = results.select(by).distinct().select(by, names).select(by, "b.bucket", "b.one")
    rows = results.select(by, bucket(F.coalesce("score", F.lit(0))).alias("bucket"), F.lit(1).alias("one"))
    return rows.unionByName(zero).groupBy(by, "bucket").agg(F.sum("one").alias("n"))


def weak_topics(results: DataFrame, least_rate: float = 0.8, low_score: int = 60) -> DataFrame:
    """Topics under the acceptance rate or with a low score (a missing one is 0) or a check that failed, not one that is missing."""
    groups = results.groupBy("topic").agg(
        *summary(),
        F.count_if(F.coalesce("score", F.lit(0)) < low_score).alias("n_low"),
        F.count_if(F.col("compile_passed") == F.lit(False)).alias("n_compile_failed"),
        F.count_if(F.col("runtime_passed") == F.lit(False)).alias("n_runtime_failed"),
    )
    return groups.where((F.col("n_accepted") / F.col("n") < least_rate) | (F.col("n_low") + F.col("n_compile_failed") + F.col("n_runtime_failed") > 0))


def min_topic_acceptance(results: DataFrame, by: str) -> DataFrame:
    """The least acceptance rate of a topic within each group."""
    rates = results.groupBy(by, "topic").agg(F.avg(F.coalesce("accepted", F.lit(False)).cast("int")).alias("rate"))
    return rates.groupBy(by).agg(F.bround(F.min("rate"), 3).alias("min_acceptance"))


def weighted_mean(results: DataFrame) -> DataFrame:
    """Each model's mean over its runs' averages, weighted by the tasks of a run."""
    runs = results.groupBy("model", "run_id").agg(F.count("*").alias("tasks"), F.bround(F.avg(F.coalesce("score", F.lit(0))), 2).alias("avg_score"))
    return runs.groupBy("model").agg(F.sum("tasks").alias("tasks"), F.bround(F.sum(F.col("avg_score") * F.col("tasks")) / F.sum("tasks"), 2).alias("avg_score"))


def flaky_tasks(results: DataFrame, tolerance: float = 5.0, min_runs: int = 2) -> DataFrame:
    """Tasks whose scores spread over a model's runs by more than the tolerance."""
    groups = results.groupBy("model", "id").agg(F.count("*").alias("runs"), (F.max(F.coalesce("score", F.lit(0))) - F.min(F.coalesce("score", F.lit(0)))).alias("score_range"))
    return groups.where((F.col("runs") >= min_runs) & (F.col("score_range") > tolerance))
