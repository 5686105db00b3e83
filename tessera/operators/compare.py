"""Runs against runs: differences, verdicts, previous runs, trends and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of the regression policy.
POLICY = {"accepted_drop": 0, "avg_drop": 1.0, "rate_drop": 0.0, "task_drop": 20, "max_newly_broken": 0, "avg_gain": 1.0}


def run_diff(base: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Tasks of either run with both scores and what became of them. A task that a run lacks scored 0 and wasn't
    accepted. With more keys (as the runs compared), many pairs of runs are compared in one join."""
    side = lambda d, p: d.select(*keys, F.coalesce("score", F.lit(0)).alias(f"{p}_score"), F.coalesce("accepted", F.lit(False)).alias(f"{p}_ok"))
    j = side(base, "base").join(side(new, "new"), list(keys), "full_outer")
    j = j.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("base_score", "new_score")} | {c: F.coalesce(c, F.lit(False)) for c in ("base_ok", "new_ok")})
    b, n = F.col("base_ok"), F.col("new_ok")
    change = F.when(b & ~n, "newly_broken").when(~b & n, "newly_fixed").when(b, "unchanged_pass").otherwise("unchanged_fail")
    return j.select(*keys, "base_score", "new_score", change.alias("change"))


def task_deltas(base: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("id",), how: str = "inner") -> DataFrame:
    """Tasks of both runs with the change of their scores and both verdicts; a missing score is 0. With a full outer
    join, tasks of either run."""
    side = lambda d, p: d.select(*keys, F.coalesce("score", F.lit(0)).alias(f"{p}_score"), F.coalesce("accepted", F.lit(False)).alias(f"{p}_ok"))
    j = side(base, "base").join(side(new, "new"), list(keys), how).na.fill(0, ["base_score", "new_score"]).na.fill(False, ["base_ok", "new_ok"])
    return j.withColumn("delta", F.col("new_score") - F.col("base_score"))


def against_previous(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base and new rows of every run and its previous run, both under to_run and previous_run: one shuffle each,
    whatever the number of runs. The runs are one row each, so their pairs are few."""
    pairs = previous_run(runs_of(results)).where("previous_run IS NOT NULL").select(F.col("run_id").alias("to_run"), "previous_run")
    new = results.join(pairs, F.col("run_id") == F.col("to_run"))
    base = results.join(pairs, F.col("run_id") == F.col("previous_run"))
    return base, new


#: Checks whose pass rates are compared between runs.
RATES = ("compile", "runtime", "semantic", "keyword")


def runs_of(results: DataFrame) -> DataFrame:
    """One row per run: model, stamp, tasks, accepted, averages and rates. A missing score counts 0, a missing check as failed."""
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    return results.groupBy("model", "run_id").agg(
        F.min("stamp").alias("stamp"),
        F.count("*").alias("tasks"),
        F.count_if("accepted").alias("accepted"),
        F.avg(F.coalesce("score", F.lit(0))).alias("avg_score"),
        *[share(f"{c}_passed").alias(f"{c}_rate") for c in RATES],
        share("timed_out").alias("timeout_rate"),
    )


def previous_run(runs: DataFrame, at: str = "stamp") -> DataFrame:
    """Each run with the latest one of the same model that is strictly before it: runs of an equal time aren't.
    Of several at that time, the one with the greatest id."""
    before = Window.partitionBy("model").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    times = Window.partitionBy("model").orderBy(at)
    ranked = runs.withColumn("_t", F.dense_rank().over(times))
    return ranked.withColumn("previous_run", F.max(F.struct("_t", "run_id")).over(before)["run_id"]).drop("_t")


def signals(policy: dict = POLICY) -> tuple[Column, Column]:
    """Reasons for a regression and for an improvement in a row of deltas, as two arrays."""
    c = F.col
    worse = (
        ("accepted", c("accepted_delta") < -policy["accepted_drop"]),
        ("avg_score", c("avg_delta") < -policy["avg_drop"]),
        ("compile_rate", c("compile_delta") < -policy["rate_drop"]),
        ("runtime_rate", c("runtime_delta") < -policy["rate_drop"]),
        ("newly_broken", c("newly_broken") > policy["max_newly_broken"]),
        ("task_drop", c("big_drops") > 0),
    )
    kept = c("newly_broken") == 0
    better = (("accepted", kept & (c("accepted_delta") > 0)), ("avg_score", kept & (c("avg_delta") >= policy["avg_gain"])))
    said = lambda rules: F.array_compact(F.array(*[F.when(x, name) for name, x in rules]))
    return said(worse), said(better)


def verdict(worse: Column, better: Column) -> Column:
    """regression, improvement, manual_review (both) or pass (neither)."""
    w, b = F.size(worse) > 0, F.size(better) > 0
    return F.when(w & b, "manual_review").when(w, "regression").when(b, "improvement").otherwise("pass")


def run_deltas(results: DataFrame, policy: dict = POLICY) -> DataFrame:
    """Every run against the previous one of its model: changes of the averages and rates, tasks newly broken, large
    drops and the largest one. A run without a previous one has a null previous_run and null changes."""
    runs = previous_run(runs_of(results))
    numbers = ["accepted", "avg_score", *[f"{c}_rate" for c in RATES], "timeout_rate"]
    old = runs.select(F.col("run_id").alias("previous_run"), *[F.col(c).alias(f"b_{c}") for c in numbers])
    change = lambda c, name, digits: F.bround(F.col(c) - F.col(f"b_{c}"), digits).alias(name)
    delta = runs.join(old, "previous_run", "left").select(
        "model", "run_id", "previous_run", (F.col("accepted") - F.col("b_accepted")).alias("accepted_delta"), change("avg_score", "avg_delta", 1),
        *[change(f"{c}_rate", f"{c}_delta", 3) for c in RATES], change("timeout_rate", "timeout_delta", 3),
    )
    base, new = against_previous(results)
    side = lambda d, p: d.select("to_run", "id", F.coalesce("score", F.lit(0)).alias(f"{p}_score"), F.coalesce("accepted", F.lit(False)).alias(f"{p}_ok"))
    tasks = side(base, "base").join(side(new, "new"), ["to_run", "id"], "full_outer").withColumn("delta", F.col("new_score") - F.col("base_score"))  # null for a task of one run only
    per_run = tasks.groupBy(F.col("to_run").alias("run_id")).agg(
        F.count_if(F.coalesce("base_ok", F.lit(False)) & ~F.coalesce("new_ok", F.lit(False))).alias("newly_broken"), F.count_if(F.col("delta") < -policy["task_drop"]).alias("big_drops"), F.min("delta").alias("largest_drop")
    )
    return delta.join(per_run, "run_id", "left").na.fill(0, ["newly_broken", "big_drops"])


def regressions(results: DataFrame, policy: dict = POLICY) -> DataFrame:
    """run_deltas with the policy's verdict and reasons; no_reference for a run that has nothing before it."""
    d = run_deltas(results, policy)
    worse, better = signals(policy)
    d = d.withColumns({"worse": worse, "better": better})
    said = F.when(F.col("previous_run").isNull(), "no_reference").otherwise(verdict(F.col("worse"), F.col("better")))
    reasons = F.array_join(F.concat("worse", F.transform("better", lambda x: F.concat(F.lit("+"), x))), ",")
    return d.withColumns({"verdict": said, "reasons": F.when(F.col("previous_run").isNull(), "").otherwise(reasons)}).drop("worse", "better")


def trend(runs: DataFrame, band: float = 1.0) -> DataFrame:
    """First and latest run of each model by time (then id) and whether its average moved out of the band."""
    rounded = runs.select("model", "run_id", F.struct("stamp", "run_id").alias("at"), F.bround("avg_score", 1).alias("avg_score"))
    t = rounded.groupBy("model").agg(
        F.count("*").alias("run_count"), F.min("at")["run_id"].alias("first_run"), F.max("at")["run_id"].alias("latest_run"),
        F.min_by("avg_score", "at").alias("first_avg"), F.max_by("avg_score", "at").alias("latest_avg"),
    )
    d = F.col("latest_avg") - F.col("first_avg")
    return t.withColumn("trend", F.when(F.col("run_count") < 2, "insufficient_history").when(d > band, "improving").when(d < -band, "declining").otherwise("flat"))


def series(runs: DataFrame) -> DataFrame:
    """Each model's runs in order of time, as one array: run_id, avg_score, accepted."""
    point = F.struct("stamp", "run_id", F.bround("avg_score", 1).alias("avg_score"), "accepted")
    return runs.groupBy("model").agg(F.sort_array(F.collect_list(point)).alias("runs"))


def latest_two(runs: DataFrame) -> DataFrame:
    """The last two runs of each model."""
    n = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("stamp"), F.desc("run_id")))
    return runs.withColumn("n", n).where("n <= 2").select("model", "run_id", F.col("n").cast("bigint").alias("n"))


def leaderboard(runs: DataFrame, limit: int = 10) -> DataFrame:
    """The best runs by average, accepted tasks and time, missing averages last, with their ranks."""
    best = runs.withColumn("_avg", F.coalesce(F.bround("avg_score", 1), F.lit(-1.0))).orderBy(F.desc("_avg"), F.desc("accepted"), F.desc("stamp"), F.desc("run_id")).limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("_avg"), F.desc("accepted"), F.desc("stamp"), F.desc("run_id")))  # of limit rows
    return best.select(rank.cast("bigint").alias("rank"), "run_id", "model", F.col("_avg").alias("avg_score"), "accepted")
