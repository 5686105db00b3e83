"""Listings of file trees: what lies there without reading it, what is left out and why."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words in a report's name that are tags of it, suffixes of reports.
TAGS = ("regression", "promotion", "routing", "benchmark", "summary", "snapshot")
REPORTS = ("json", "md", "jsonl")


def listing(spark: SparkSession, roots: str | Sequence[str], pattern: str = "*") -> DataFrame:
    """path, size, modified of every file below the roots. The content column isn't asked for, so no file is opened. Empty
    files aren't listed."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(roots if isinstance(roots, str) else list(roots))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def report_index(spark: SparkSession, roots: Mapping[str, tuple[str, Sequence[str]]], suffixes: Sequence[str] = REPORTS) -> DataFrame:
    """report_type, path, size, modified, tags of all reports, newest first. roots: by type, a folder and its tags; a word of
    TAGS in a name is a tag as well. One listing covers all roots."""
    files = listing(spark, [path for path, _ in roots.values()])
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]*)\z", 1)).isin(*suffixes))
    bare = lambda p: F.regexp_replace(p, "^[a-z]+:/*", "/")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    of = [F.when(bare(F.col("path")).startswith(bare(F.lit(path.rstrip("/") + "/"))), F.struct(F.lit(kind).alias("kind"), F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"))) for kind, (path, tags) in roots.items()]
    said = F.filter(F.array(*[F.when(F.contains(name, F.lit(t)), t) for t in TAGS]), lambda t: t.isNotNull())
    rows = files.withColumn("_r", F.coalesce(*of))
    return rows.select(F.col("_r.kind").alias("report_type"), "path", "size", "modified", F.array_sort(F.array_union("_r.tags", said)).alias("tags")).orderBy(F.desc("modified"), "path")


def latest(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The file changed last, of each group; of files changed together the first by path."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("modified"), "path")) if by else None
    return files.orderBy(F.desc("modified"), "path").limit(1) if n is None else files.withColumn("_n", n).where("_n = 1").drop("_n")


def released(files: DataFrame, path: str, parts: Sequence[str], suffixes: Sequence[str], prefixes: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Files that a release takes, and what it leaves out: path, reason.

    A folder (or file) is left out if its name is one of parts or if it lies at one of prefixes (path: reason), a file also for its
    suffix. A folder that is left out is told once, at its highest place, and nothing below it is looked at."""
    of = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: p != "")
    n = F.size("_p")

    def reason(upto: Column) -> Column:
        """Why the path's first parts are left out, null if they stay."""
        here = F.slice("_p", 1, upto)
        why = F.when(F.element_at("_p", upto).isin(*parts), "development or cache")
        for prefix, text in prefixes.items():
            names = [x for x in prefix.split("/") if x]
            why = why.when((upto == len(names)) & (here == F.array(*[F.lit(x) for x in names])), text)
        return why

    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), reason(i).alias("why")))
    first = F.get(F.filter(at, lambda x: x["why"].isNotNull()), 0)
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)\z", 1))
    rows = files.withColumn("_p", of).where(n > 0).withColumn("_first", first)
    why = F.coalesce("_first.why", F.when(suffix.isin(*suffixes), F.concat(F.lit("suffix "), suffix)))
    told = rows.withColumns({"_why": why, "_where": F.array_join(F.slice("_p", 1, F.coalesce("_first.i", n)), "/")})
    left = told.where("_why IS NOT NULL").select(F.col("_where").alias("path"), F.col("_why").alias("reason")).distinct()
    return told.where("_why IS NULL").select(*files.columns), left
