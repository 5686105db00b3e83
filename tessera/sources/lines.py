"""Lines of text files with their numbers, however the files are split, and JSON lines that name the line that is bad."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BAD = "_json_error"


def numbered_lines(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """file, line (from 1), value of every line, blank ones too. A line ends with a line feed, a carriage return or both.

    Spark reads a large file in splits, each by its own task. A first pass counts the lines of every split, a prefix
    sum over the splits of a file (few rows) tells where each starts, and the second pass adds a line's place in its split."""
    meta = F.col("_metadata")
    read = spark.read.options(**options).text(path).select("value", meta.file_path.alias("file"), meta.file_block_start.alias("_split"), F.monotonically_increasing_id().alias("_at"))
    splits = read.groupBy("file", "_split").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "_split", (F.coalesce(before, F.lit(0)) + 1 - F.col("_first")).alias("_add"))
    return read.join(splits, ["file", "_split"]).select("file", (F.col("_at") + F.col("_add")).alias("line"), "value")


def _parsed(lines: DataFrame, schema: StructType) -> DataFrame:
    """Lines that aren't blank, with their fields in _o; _o's _json_error holds a line that can't be read."""
    whole = StructType([*schema.fields]).add(_BAD, "string")
    parsed = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    return lines.where(F.trim(F.col("value"), F.lit(" \t\x0b\f")) != "").withColumn("_o", parsed)


def _place(file: Column, line: Column) -> Column:
    return F.concat(F.element_at(F.split(file, "/"), -1), F.lit(":"), line.cast("string"))


def read_strict(spark: SparkSession, path: str | list[str], schema: StructType, **options) -> DataFrame:
    """JSON lines with file and line; blank lines are skipped, and a bad line fails the query with file:line in its message.

    The check is part of every column, so that a query of a few columns fails as well."""
    rows = _parsed(numbered_lines(spark, path, **options), schema)
    told = F.raise_error(F.concat(_place(F.col("file"), F.col("line")), F.lit(": invalid JSON line"))).cast(schema)
    checked = rows.withColumn("_o", F.when(F.col(f"_o.{_BAD}").isNull(), F.struct(*[F.col(f"_o.{f}").alias(f) for f in schema.fieldNames()])).otherwise(told))
    return checked.select("file", "line", "_o.*")


def read_permissive(spark: SparkSession, path: str | list[str], schema: StructType, **options) -> DataFrame:
    """JSON lines with _line; a bad line is a row without fields whose _json_error holds it."""
    rows = _parsed(numbered_lines(spark, path, **options), schema)
    good = lambda f: F.when(F.col(f"_o.{_BAD}").isNull(), F.col(f"_o.{f}")).alias(f)
    return rows.select("file", F.col("line").alias("_line"), *[good(f) for f in schema.fieldNames()], F.col(f"_o.{_BAD}").alias(_BAD))
