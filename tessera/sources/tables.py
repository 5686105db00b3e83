"""Tables, JSON lines readers and writers, and the evaluation results that queries work on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Folders of local applications without spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, a temporary one for each
    application in local mode; on a cluster the executors couldn't see that, so the setting is asked for."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tessera-"))


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what depends on chance in it, as the bounds of a range
    partitioning, is then the same for every reader."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped and a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_permissive(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines; a bad line becomes a row whose _json_error holds the line."""
    with_error = StructType([*schema.fields]).add("_json_error", "string")
    return spark.read.schema(with_error).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_json_error").json(path)


def read_json_files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One object (or list) per *.json file, with _filename; unreadable files are left out."""
    with_error = StructType([*schema.fields]).add("_bad", "string")
    rows = spark.read.schema(with_error).option("multiLine", True).option("pathGlobFilter", "*.json").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.select(*schema.fieldNames(), F.col("_metadata.file_name").alias("_filename"), "_bad").where("_bad IS NULL").drop("_bad")


def read_documents(spark: SparkSession, path: str, suffixes=("md", "txt", "html")) -> DataFrame:
    """Whole text files below a folder, by suffix in any case: source (path) and text. Other files aren't read."""
    either = lambda x: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x)
    glob = "*.{" + ",".join(map(either, suffixes)) + "}"
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_splits(df: DataFrame, path: str, split: str = "split", kind: str = "type") -> None:
    """A folder of JSON lines for each split and type."""
    df.write.mode("overwrite").partitionBy(split, kind).json(path)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace rows of existing with an equal key, compared without case and outer spaces."""
    norm = lambda c: F.lower(F.trim(c))
    keys = new.select(norm(F.col(key)).alias("_key")).distinct()
    return existing.join(keys, norm(F.col(key)).eqNullSafe(F.col("_key")), "left_anti").unionByName(new)


_DAY = "CAST(substring(CAST(ts AS STRING), 9, 2) AS INT)"
#: Columns of the evaluation results as SQL over events that Spark and DuckDB both read. Checks are independent
#: of the score and of one another, some are null, and two runs in a row share a stamp.
EVAL_COLUMNS = {
    "model": "concat('m', CAST(user_id % 3 AS STRING))",
    "run_id": "concat('m', CAST(user_id % 3 AS STRING), '_', replace(substring(CAST(ts AS STRING), 1, 10), '-', ''))",
    "stamp": f"concat(substring(CAST(ts AS STRING), 1, 8), lpad(CAST({_DAY} - {_DAY} % 2 AS STRING), 2, '0'))",
    "id": "concat(event_type, '_', CAST(user_id % 10 AS STRING))",
    "benchmark": "CASE WHEN user_id % 10 < 5 THEN 'strict_v2' ELSE 'generated_v1' END",
    "topic": "event_type",
    "difficulty": "CASE event_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END",
    "year": "CASE WHEN event_id % 41 = 0 THEN NULL ELSE 2019 + event_id % 6 END",
    "score": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) % 101 END",
    "accepted": "CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) % 101 >= 60 END",
    "proxy_passed": "event_id % 23 <> 0",
    "truncation_passed": "CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_id % 9 <> 0 END",
    "has_main": "event_id % 12 <> 0",
    "compile_passed": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 7 <> 0 END",
    "runtime_passed": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 5 <> 0 END",
    "semantic_passed": "event_id % 8 <> 0",
    "keyword_passed": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE event_id % 6 <> 0 END",
    "timed_out": "event_id % 37 = 0",
    "match_ratio": "CASE WHEN event_id % 14 = 3 THEN NULL ELSE CAST(event_id % 11 AS DOUBLE) / 10 END",
    "compile_error": "CASE event_id % 6 WHEN 0 THEN 'error: expected ;' WHEN 1 THEN 'x undeclared' WHEN 2 THEN 'Array subscript' WHEN 3 THEN 'stray character' WHEN 4 THEN 'ld failed' END",
    "seq": "event_id",
}


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation results derived from events: one row per run and task, the best score (a missing one is the least), the first on a tie."""
    e = table(spark, sf_dir, "events")
    rows = e.select(*[F.expr(x).alias(c) for c, x in EVAL_COLUMNS.items()], F.get_json_object("props", "$.k").cast("bigint").alias("latency_ms"))
    best = Window.partitionBy("run_id", "id").orderBy(F.desc(F.coalesce("score", F.lit(-1))), "seq")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


#: The same for DuckDB, as the start of a WITH clause.
EVAL_SQL = f"""WITH raw AS (SELECT {", ".join(f"{x} AS {c}" for c, x in EVAL_COLUMNS.items())}, json_extract_string(props, '$.k')::BIGINT AS latency_ms FROM events),
r AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY coalesce(score, -1) DESC, seq) = 1)"""
