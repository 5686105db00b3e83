"""Ordered deduplication: which row of a key stays is fixed by an order, never by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import staged


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def last_value_first_place(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key, with the place where the key first came."""
    by = Window.partitionBy(*keys)
    rows = df.withColumns({"first_seq": F.min(seq).over(by), "_last": F.max(seq).over(by)})
    return rows.where(F.col(seq) == F.col("_last")).drop("_last")


def duplicates(df: DataFrame, key: str, line: str) -> DataFrame:
    """Rows whose key came before, with the line that had it first. First lines are added up before the shuffle and
    only keys that repeat are joined, so a key of very many rows isn't gathered in one task."""
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(line).alias("first_line"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(first, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").where(F.col(line) > F.col("first_line"))


#: Rows of a key up to which one window takes the key as a whole; beyond, its rows are spread over tasks. Both give the same.
WHOLE_KEY = 1_000_000


def running(df: DataFrame, key: str, order: str, value: str, how) -> DataFrame:
    """df with _before: the aggregate how (F.sum or F.max) of value over the key's rows before each, null for the first.

    Where a key has very many rows, they are range-partitioned by (key, order), so one key's rows may span tasks; what a key
    had in the partitions before comes from one row per key and partition."""
    most = df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if most <= WHOLE_KEY:
        return df.withColumn("_before", how(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    parts = staged(df.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()))
    ends = parts.groupBy(key, "_part").agg(how(value).alias("_all"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), how("_all").over(earlier).alias("_start"))
    own = Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    j = parts.withColumn("_within", how(value).over(own)).join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    both = F.greatest("_start", "_within") if how is F.max else F.when(F.col("_start").isNotNull() | F.col("_within").isNotNull(), F.coalesce("_start", F.lit(0)) + F.coalesce("_within", F.lit(0)))
    return j.withColumn("_before", both).select(*df.columns, "_before")


def running_best(df: DataFrame, key: str, score: str, seq: str) -> DataFrame:
    """Each row with the best score of its key so far and whether it sets it; a tie goes to the later row."""
    before = running(df.select(key, seq, score), key, seq, score, F.max)
    return before.select(key, seq, score, F.greatest("_before", score).alias("best"), F.coalesce(F.col(score) >= F.col("_before"), F.lit(True)).alias("is_best"))
