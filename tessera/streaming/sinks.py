"""Sinks of streams that a batch may reach twice: what a batch writes is named by its number, so writing it again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.dedup import keep_first

_BATCH = "batch_id"


def _folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose folders are complete."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    names = [f.getPath() for f in fs.listStatus(top)]
    return sorted(int(p.getName().partition("=")[2]) for p in names if p.getName().startswith(f"{_BATCH}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _drop(spark: SparkSession, path: str) -> None:
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def append_jsonl(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is a folder of JSON lines of its own; a batch that comes again replaces it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/{_BATCH}={batch_id}")

    return write


def appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows appended so far, with batch_id. Folders that a batch didn't finish are left out."""
    done = _folders(spark, path)
    if not done:
        return spark.createDataFrame([], schema).withColumn(_BATCH, F.lit(0).cast("bigint"))
    rows = spark.read.schema(schema).option("basePath", path).json([f"{path}/{_BATCH}={k}" for k in done])
    return rows.withColumn(_BATCH, F.col(_BATCH).cast("bigint"))


def upsert_best(path: str, key: list[str], score: str, seq: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a table with the best row of each key, the later one on a tie. A batch merges with the newest
    version before it and writes its own, so a batch that comes again gives the same version. The last few stay."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [k for k in _folders(spark, path) if k < batch_id]
        rows = batch if not before else spark.read.schema(batch.schema).parquet(f"{path}/{_BATCH}={before[-1]}").unionByName(batch)
        keep_first(rows, key, F.desc_nulls_last(score), F.desc(seq)).write.mode("overwrite").parquet(f"{path}/{_BATCH}={batch_id}")
        for k in before[: -(keep - 1)] if keep > 1 else before:
            _drop(spark, f"{path}/{_BATCH}={k}")

    return write


def best_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of an upserted table."""
    return spark.read.parquet(f"{path}/{_BATCH}={_folders(spark, path)[-1]}")


def run(stream: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Feed all that has come to the sinks, batch by batch, and stop; a restart from the checkpoint goes on behind it."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, batch_id)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
