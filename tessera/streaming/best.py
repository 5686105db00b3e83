"""Running bests over a stream of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def best_so_far(attempts: DataFrame, key: str, score: str, seq: str) -> DataFrame:
    """The best attempt of each key, the later one on a tie; works on batches and, in update mode, on streams.

    State is one row per key."""
    best = F.max(F.struct(F.col(score).alias("score"), F.col(seq).alias("seq")))
    return attempts.groupBy(key).agg(best.alias("b"), F.count("*").alias("attempts")).select(key, F.col("b.score").alias("best"), F.col("b.seq").alias("seq"), "attempts")


def windowed_counts(events: DataFrame, ts: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per key and window; events later than the watermark are left out of streams."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
