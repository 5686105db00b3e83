"""Line dedup by site-relative frequency.

Pages are grouped by host; a line's ratio is the number of the host's pages that contain it over the
host's page total. Lines above the ratio are boilerplate and are dropped from the host's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: A line on more than this share of its host's pages, and on so many pages at least, is boilerplate.
RATIO, MIN_PAGES = 0.1, 5
#: Hosts' boilerplate lines that may be broadcast (8 bytes each); beyond, hosts are joined by shuffle.
BROADCAST_LINES = 250_000


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """A line's identity: a hash of the line without the white space around it."""
    return F.xxhash64(F.trim(line, F.lit(" \t\x0b\f\r")))


def host_of(url: str) -> Column:
    """Host of a URL column in lower case, to group pages by; null where there is none."""
    return F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host that has boilerplate: _host, _boiler (keys of its lines).

    A page counts a line once. Each host has at most (mean lines per page / ratio) such lines, so the
    list of a host is bounded however many pages it has. Counts are pre-aggregated before the shuffle.
    """
    blank = F.xxhash64(F.lit(""))
    keys = F.array_except(F.array_distinct(F.transform(_lines(text), _key)), F.array(blank))
    per_line = df.select(F.col(host).alias("_host"), F.explode(keys).alias("_key")).groupBy("_host", "_key").agg(F.count("*").alias("_n"))
    pages = df.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("_pages"))
    common = per_line.where(F.col("_n") >= min_pages).alias("l").join(pages.alias("p"), F.col("l._host").eqNullSafe(F.col("p._host")))
    return common.where(F.col("_n") > ratio * F.col("_pages")).groupBy("l._host").agg(F.sort_array(F.collect_list("_key")).alias("_boiler"))


def line_dedup(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """df with its text without boilerplate lines, and n_lines and n_dropped.

    Lines are parts between line feeds, compared without white space at their ends; blank lines stay.
    A null text stays null, with n_lines 0; an empty one is one blank line. A null host is a host of
    its own. Repeated rows are pages of their own, each counted. A page that loses every line stays,
    with an empty text. Columns of df named n_lines, n_dropped, _host or _boiler are replaced.
    """
    out = df.drop("n_lines", "n_dropped", "_host", "_boiler")
    hosts = stage(boilerplate(df, host, text, ratio, min_pages), "boilerplate")
    if (hosts.agg(F.sum(F.size("_boiler") + 8)).first()[0] or 0) <= BROADCAST_LINES:
        hosts = F.broadcast(hosts)
    joined = out.join(hosts, F.col(host).eqNullSafe(F.col("_host")), "left")
    kept = F.filter(_lines(text), lambda x: ~F.array_contains(F.col("_boiler"), _key(x)))
    joined = joined.withColumn("_kept", F.when(F.col("_boiler").isNotNull(), kept).otherwise(_lines(text)))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(text))).cast("long")
    new = F.when(F.col(text).isNotNull(), F.array_join("_kept", "\n"))
    dropped = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(text)) - F.size("_kept")).cast("long")
    return joined.select(*[new.alias(c) if c == text else F.col(c) for c in out.columns], n.alias("n_lines"), dropped.alias("n_dropped"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_dropped", "text")


SQL = {
    "op8_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT r, source, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM x),
n AS (SELECT source, k, count(DISTINCT r) AS n FROM k WHERE k <> '' GROUP BY ALL),
p AS (SELECT source, count(*) AS pages FROM d GROUP BY ALL),
b AS (SELECT n.source, k FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source WHERE n >= {MIN_PAGES} AND n > {RATIO}::DOUBLE * pages),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source IS NOT DISTINCT FROM k.source AND b.k = k.k) GROUP BY r)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, (coalesce(len(l), 0) - coalesce(n, 0))::BIGINT AS n_dropped,
       CASE WHEN l IS NOT NULL THEN coalesce(text, '') END AS text FROM d LEFT JOIN kept USING (r)"""
}
QUERIES = {"op8_line_dedup": op8_line_dedup}
