"""Runs, registries and stages kept as folders of JSON files: one scan of all files, keys taken from their paths.

A folder's name may be written as ``key=name``. Files that can't be read are left out or become a row that says so.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

_BAD = "_bad"


def _part(path: Column, place: int) -> Column:
    """A path's part from its end (1: the file), without key=."""
    return F.regexp_replace(F.url_decode(F.element_at(F.split(path, "/"), -place)), "^[A-Za-z_]+=", "")


def stem(name: Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(name, r"\.[^.]*\z", "")


def _read(spark: SparkSession, paths: str | list[str], schema: StructType | str, **options) -> DataFrame:
    """One row for each file that holds an object (or for each object of a list), with _path and _bad (the text of a file
    that can't be read)."""
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    whole = StructType([*fields]).add(_BAD, "string")
    reader = spark.read.schema(whole).options(multiLine=True, columnNameOfCorruptRecord=_BAD, **options)
    return reader.json(paths).select("*", F.col("_metadata.file_path").alias("_path"))


def write_file(spark: SparkSession, lines: DataFrame, path: str) -> None:
    """A few lines (one text column) as one file of exactly that name, for reports: Spark writes them to a folder beside it
    and a rename puts them in place, so a reader sees the old file or the new one."""
    folder = f"{path}.{uuid.uuid4().hex}"
    lines.coalesce(1).write.text(folder)
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = fs.globStatus(jvm.Path(f"{folder}/part-*"))[0].getPath()
    if fs.exists(jvm.Path(path)):
        fs.delete(jvm.Path(path), False)
    fs.rename(part, jvm.Path(path))
    fs.delete(jvm.Path(folder), True)


#: What a run's report has of use here.
REPORT = (
    "timestamp string, model string, accepted bigint, average_score double, rates struct<compile_pass_rate: double, runtime_pass_rate: double>, "
    "meta struct<model: string, prompt_profile: string, max_tokens: bigint, temperature: double, model_override_valid: boolean>"
)
RESULT = "id string, score bigint"


def _reports(spark: SparkSession, reports: str) -> DataFrame:
    rows = _read(spark, reports, REPORT).where(F.col(_BAD).isNull())
    model = F.coalesce(F.nullif(F.col("meta.model"), F.lit("")), F.nullif(F.col("model"), F.lit("")), F.lit("unknown"))
    return rows.withColumns({"run_id": _part(F.col("_path"), 2), "model": model})


def run_reports(spark: SparkSession, reports: str, results: str | None = None) -> DataFrame:
    """run_id (the folder's name), model, timestamp, accepted, avg_score, compile_rate, runtime_rate, has_results of every
    run whose report can be read. reports and results are globs, as root/*/report.json and root/*/results.jsonl.

    Results are told by their paths: their content isn't read. An empty file counts as none."""
    number = lambda c, digits: F.bround(F.coalesce(F.col(c), F.lit(0.0)), digits)
    rows = _reports(spark, reports).select(
        "run_id", "model", F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.coalesce("accepted", F.lit(0)).alias("accepted"), number("average_score", 1).alias("avg_score"),
        number("rates.compile_pass_rate", 3).alias("compile_rate"), number("rates.runtime_pass_rate", 3).alias("runtime_rate"),
    )
    if not results:
        return rows.withColumn("has_results", F.lit(False))
    there = spark.read.format("binaryFile").load(results).select(_part(F.col("path"), 2).alias("run_id")).distinct().withColumn("has_results", F.lit(True))
    return rows.join(there, "run_id", "left").withColumn("has_results", F.coalesce("has_results", F.lit(False)))


def run_results(spark: SparkSession, reports: str, results: str) -> DataFrame:
    """One row for each run whose report can be read: run_id, model, stamps of its settings, and results, an array of
    (id, score) in the order of ids; a missing score is 0. A run without results has an empty array."""
    meta = [F.col(f"meta.{f}").alias(f) for f in ("prompt_profile", "max_tokens", "temperature", "model_override_valid")]
    rows = _reports(spark, reports).select("run_id", "model", *meta)
    lines = spark.read.schema(RESULT).json(results).select(_part(F.col("_metadata.file_path"), 2).alias("run_id"), "id", F.coalesce("score", F.lit(0)).alias("score"))
    nested = lines.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("id", "score"))).alias("results"))
    return rows.join(nested, "run_id", "left").withColumn("results", F.coalesce("results", F.array().cast(nested.schema["results"].dataType)))


def registry(spark: SparkSession, files: str, schema: StructType, invalid: bool = True) -> DataFrame:
    """Registry entries, one JSON file each, newest first: the fields, _path, error. run_id defaults to the file's stem. A file
    that can't be read is an entry of run_type invalid with an empty timestamp, or is left out."""
    rows = _read(spark, files, schema)
    bad = F.col(_BAD).isNotNull()
    of = {"run_id": F.coalesce("run_id", stem(_part(F.col("_path"), 1))), "error": F.when(bad, F.lit("not a JSON object"))}
    of |= {"run_type": F.when(bad, F.lit("invalid")).otherwise(F.col("run_type")), "timestamp": F.when(bad, F.lit("")).otherwise(F.coalesce("timestamp", F.lit("")))}
    rows = rows.withColumns(of).drop(_BAD)
    return (rows if invalid else rows.where("error IS NULL").drop("error")).orderBy(F.desc("timestamp"), "_path")


def failed_cases(spark: SparkSession, files: str, schema: StructType) -> DataFrame:
    """All runs' failed cases with run_id. A file with a line that can't be read is left out as a whole."""
    whole = StructType([*schema.fields]).add(_BAD, "string")
    rows = spark.read.schema(whole).option("columnNameOfCorruptRecord", _BAD).json(files).withColumn("_path", F.col("_metadata.file_path"))
    # Spark refuses to read the text of bad lines alone, so a field comes along.
    worst = F.max(F.struct(F.col(_BAD).isNotNull().alias("bad"), F.col(schema.fieldNames()[0]).cast("string").alias("field")))
    bad = rows.groupBy("_path").agg(worst.alias("_worst")).where("_worst.bad").select("_path")
    return rows.join(bad, "_path", "left_anti").select(_part(F.col("_path"), 2).alias("run_id"), *schema.fieldNames())


#: Registries of adapters: file, status of an entry without one, and what they make of it; later ones win.
ADAPTER_FILES = (("promoted", "promote", True), ("default", "promote", True), ("safe", "safe_no_change", True), ("ablation", "ablation_only", False), ("rejected", "reject", False))


def adapter_registry(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """name, usable, source, and the fields of every adapter that one of ADAPTER_FILES (folder/<source>_adapters.json, and
    default_adapter.json with an entry active) lists. An adapter is named by its path's last part. One that usable
    and blocking files list has a row for each; of several usable or blocking ones the later file wins, in a file the later entry."""
    whole = StructType().add("adapters", ArrayType(schema)).add("active", schema)
    rows = _read(spark, folder, whole, pathGlobFilter="{*_adapters,default_adapter}.json", recursiveFileLookup=True).where(F.col(_BAD).isNull())
    source = F.regexp_extract(F.element_at(F.split("_path", "/"), -1), "^([a-z]+)_adapters?", 1)
    entries = F.when(source == "default", F.filter(F.array("active"), lambda a: a["adapter_path"].isNotNull() & (a["adapter_path"] != ""))).otherwise(F.col("adapters"))
    each = rows.select(source.alias("source"), F.posexplode(entries).alias("_at", "_e"))
    rank = F.create_map(*[F.lit(x) for k, (name, _, _) in enumerate(ADAPTER_FILES) for x in (name, k)])[F.col("source")]
    status = F.create_map(*[F.lit(x) for name, s, _ in ADAPTER_FILES for x in (name, s)])[F.col("source")]
    usable = F.create_map(*[F.lit(x) for name, _, u in ADAPTER_FILES for x in (name, u)])[F.col("source")]
    name = F.element_at(F.split(F.regexp_replace(F.coalesce("_e.adapter_path", F.lit("")), r"\\", "/"), "/"), -1)
    fields = [F.coalesce("_e.status", status).alias("status") if f == "status" else F.col(f"_e.{f}").alias(f) for f in schema.fieldNames()]
    named = each.select(name.alias("name"), usable.alias("usable"), "source", *fields, rank.alias("_rank"), "_at").where("_rank IS NOT NULL")
    last = Window.partitionBy("name", "usable").orderBy(F.desc("_rank"), F.desc("_at"))
    return named.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_rank", "_at")


def staged_items(spark: SparkSession, root: str, stages: Sequence[str], schema: StructType, files: str = "*.json") -> DataFrame:
    """Items of all stages (an object, or a list of them, in each of the files below root/<stage>) with _stage; files that can't be read are left out."""
    rows = _read(spark, [f"{root}/{s}" for s in stages], schema, pathGlobFilter=files, recursiveFileLookup=True).where(F.col(_BAD).isNull())
    return rows.select(*schema.fieldNames(), _part(F.col("_path"), 2).alias("_stage"), "_path")


def first_stage(items: DataFrame, stages: Sequence[str], key: str) -> DataFrame:
    """The item of each id in the first stage that has it."""
    rank = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("_stage"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(rank, "_path"))
    return items.withColumn("_n", n).where("_n = 1").drop("_n")
