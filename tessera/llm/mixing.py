"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; a document's expected copies are its source's target over
its source's words. Within a source, documents are put in order of (size, id), their expected copies
are prefix-summed from one offset drawn for the source, and a document is emitted once for each
integer boundary that its stretch of the sum crosses. The order by size makes the words taken come
near the target, the seeded offset makes reruns agree. Documents so large that one of them could move a
source off its target are sampled first, and the expected copies of the rest make up for what they take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, words

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, 7
#: A document is large if it has more than this share of its source's words.
LARGE = 0.05
#: Rows of (partition, source) positions that may be broadcast.
BROADCAST_ROWS = 100_000


def source_targets(sizes: DataFrame, source: str, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """One row per source: its words, target and offset in [0, 1).

    Sources take the weights in code-point order, null last, the list repeating. All share
    ``share`` times all words; a target stops at ``cap`` times its source's words and the excess is
    shared again by weight. Sorted by cap over weight, the sources that stop come first, so one prefix
    sum over the (few) sources finds the level that the rest share.
    """
    s = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    s = s.withColumn("_r", F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())))
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (((F.col("_r") - 1) % len(weights)) + 1).cast("int")))
    by_level = Window.orderBy(cap * F.col("source_size") / F.col("_w"), "_r")
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("_level", (share * total - cap * before) / rest)
    s = s.withColumn("_stops", cap * F.col("source_size") / F.col("_w") <= F.col("_level"))
    level = F.min(F.when(~F.col("_stops"), F.struct("_r2", "_level"))).over(Window.partitionBy())["_level"]
    s = s.withColumn("_r2", F.row_number().over(by_level)).withColumn("_final", level)
    own = cap * F.col("source_size")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("\x00")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return s.select(source, "source_size", F.when(F.col("_stops"), own).otherwise(F.least(own, F.col("_final") * F.col("_w"))).alias("target"), offset.alias("_u"))


def with_size(df: DataFrame, text: str = "text") -> DataFrame:
    """df with size: the words of the text, 0 for a null one."""
    return df.withColumn("size", F.size(words(F.col(text))).cast("long"))


def mix_sources(named: DataFrame, doc_id: str = "doc_id", source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """named (which has with_size's column) with source_size, target (of its source) and copies (how often the mix takes it).

    Every row stays, with copies 0 if it isn't taken; ``emit`` repeats them. A null source is a source of
    its own, null ids come first among rows of equal size. Rows that repeat an id are documents of their
    own; rows of equal source, size and id go by a hash of their other plain columns, so reruns agree.
    A source without words has target 0 and copies 0. An empty table gives an empty one. Columns named as
    the new ones, or with a leading underscore as the inner ones (_at, _part, _first, _before, _rows, _u,
    _small, _large, _p_part, _p_source), are replaced.

    The order within a source is global: rows are range-partitioned by (source, size, id), so a
    source with a third of all rows spans many tasks, and a position is the position in its
    partition plus the count of its source in the partitions before. Large documents are last in that
    order; their prefix sum runs from the largest down.
    """
    named = named.drop("source_size", "target", "copies", "_at", "_part", "_first", "_before", "_rows", "_u", "_small", "_large", "_p_part", "_p_source")
    plain = [F.col(c) for c, kind in named.dtypes if kind in ("string", "bigint", "int", "double", "date", "timestamp", "boolean")]
    order = [F.col(source).asc_nulls_last(), "size", doc_id, F.xxhash64(*plain)]
    ranged = named.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stage(ranged.withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}), "mixing")
    counts = ranged.groupBy("_part", source).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.sum("size").alias("size"))
    targets = source_targets(counts, source, weights, share, cap, seed)
    by = Window.partitionBy(source)
    before = F.coalesce(F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"_before": before, "_rows": F.sum("_n").over(by)}).drop("size", "_n")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    places = stage(counts.alias("c").join(targets.alias("t"), same(f"c.{source}", f"t.{source}")).drop(F.col(f"t.{source}")), "mixing-places")
    small = (lambda d: F.broadcast(d)) if places.count() <= BROADCAST_ROWS else (lambda d: d)
    p = places.withColumnsRenamed({"_part": "_p_part", source: "_p_source"})
    rank = F.col("_at") - F.col("_first") + F.col("_before")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = lambda each, at: F.floor(each * (at + 1) + F.col("_u")) - F.floor(each * at + F.col("_u"))
    large = F.col("size") > LARGE * F.col("source_size")
    of_large = crossed(each, F.col("_rows") - 1 - rank)

    def placed(rows: DataFrame, p: DataFrame) -> DataFrame:
        return rows.join(small(p), same("_part", "_p_part") & same(source, "_p_source"))

    sums = placed(ranged.select(source, "size", "_at", "_part"), p).groupBy(F.col(source).alias("_source")).agg(F.sum(F.when(~large, F.col("size"))).alias("_small"), F.coalesce(F.sum(F.when(large, F.col("size") * of_large)), F.lit(0)).alias("_large"))
    p = stage(p.join(sums, same("_p_source", "_source")).drop("_source"), "mixing-rest")
    rest = F.least(F.lit(cap), F.greatest(F.lit(0.0), (F.col("target") - F.col("_large")) / F.col("_small")))
    copies = F.when(F.col("size") <= 0, 0).when(large, of_large).otherwise(crossed(rest, rank))
    return placed(ranged, p).withColumn("copies", copies.cast("long")).select(*named.columns, "source_size", "target", "copies")


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy, numbered from 1 in column copy."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = with_size(table(spark, sf_dir, "documents")).select("doc_id", "source", "size")
    mixed = mix_sources(stage(sized, "mixing-sizes"))  # range bounds are sampled: texts are read once
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (r - 1) % 3] AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, r) AS r2,
        coalesce(sum(source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
        sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest, (sum(source_size) OVER ())::BIGINT AS total FROM w),
l AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * before) / rest AS level FROM o),
k AS (SELECT arg_min(level, r2) AS level FROM l WHERE 2.0::DOUBLE * source_size / w > level),
t AS (SELECT l.source, source_size, CASE WHEN 2.0::DOUBLE * source_size / w <= l.level THEN 2.0::DOUBLE * source_size ELSE least(2.0::DOUBLE * source_size, k.level * w) END AS target,
        ('0x' || substr(md5('{SEED}|' || coalesce(l.source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l LEFT JOIN k ON true),
x AS (SELECT doc_id, size, d.source AS src, t.*, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS n, count(*) OVER (PARTITION BY d.source) AS rows,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each, size > {LARGE}::DOUBLE * source_size AS large FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, floor(each * (rows - n + 1) + u) - floor(each * (rows - n) + u) AS of_large FROM x),
a AS (SELECT src, sum(size) FILTER (NOT large)::DOUBLE AS small, coalesce(sum(size * of_large) FILTER (large), 0)::DOUBLE AS taken FROM y GROUP BY src),
z AS (SELECT y.*, CASE WHEN small > 0 THEN least(2, greatest(0, (target - taken) / small)) END AS rest FROM y JOIN a ON y.src IS NOT DISTINCT FROM a.src)
SELECT doc_id, size, source_size, target, (CASE WHEN size <= 0 THEN 0 WHEN large THEN size * of_large ELSE size * (floor(rest * n + u) - floor(rest * (n - 1) + u)) END)::BIGINT AS taken FROM z"""

QUERIES = {"op6_mixing": op6_mixing}
SQL = {"op6_mixing": _SQL}
