"""Exact dedup by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. All blocks of the corpus are sorted and each distinct one
gets an integer name; then the names of adjacent blocks are paired, all pairs are sorted and each distinct one gets
a name for the next level, until one name is left for each document. Texts are equal just where they have as many
blocks and the same last name, as equal names stand for equal content at every level: a 64-bit hash of
a block only brings its occurrences together with its name, and blocks that share one are told apart by
their content. Spark expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, stage, table

#: Bytes of a block.
BLOCK = 1024
#: What stands for the missing right name of a last block without a partner; names aren't negative.
_NONE = -1
_INNER = ("_row", "_blocks", "_at", "_hash", "_block", "_name", "_sha", "_part", "_level", "_best")


def _hash(block: Column) -> Column:
    return F.xxhash64(block)


def _named(sorted_: DataFrame) -> DataFrame:
    return sorted_.withColumn("_name", F.monotonically_increasing_id())


def _first_names(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """_row, _blocks, _at, _name of every block, and the staged names. Equal blocks are counted before they are shuffled,
    so one that a third of all texts hold is as cheap as any. Occurrences travel as hashes; only where one hash has
    several blocks, their content does."""
    distinct = blocks.groupBy("_hash", "_block").count()
    names = stage(_named(distinct.sortWithinPartitions("_hash", "_block")).select("_hash", "_name"), "names")
    of = stage(names.groupBy("_hash").agg(F.sort_array(F.collect_list("_name")).alias("_names")), "names")
    drop(blocks.sparkSession, names)
    place = ["_row", "_blocks", "_at"]
    one = blocks.select(*place, "_hash").join(of.where(F.size("_names") == 1), "_hash").select(*place, F.col("_names")[0].alias("_name"))
    shared = of.where(F.size("_names") > 1)
    if shared.isEmpty():
        return one, of
    several = blocks.select(*place, "_hash", "_block").join(shared, "_hash")
    rank = F.row_number().over(Window.partitionBy("_hash").orderBy("_block"))
    told = several.groupBy("_hash", "_block").agg(F.first("_names").alias("_names")).select("_hash", "_block", F.element_at("_names", rank).alias("_name"))
    return one.unionByName(several.drop("_names").join(told, ["_hash", "_block"]).select(*place, "_name")), of


def _pair(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next level of rows with more than one name: names of adjacent pairs, and the staged names."""
    side = lambda k: F.max(F.when(F.col("_at") % 2 == k, F.col("_name")))
    pairs = named.groupBy("_row", F.floor((F.col("_blocks") + 1) / 2).alias("_blocks"), F.shiftright("_at", 1).alias("_at")).agg(side(0).alias("_left"), F.coalesce(side(1), F.lit(_NONE)).alias("_right"))
    names = stage(_named(pairs.groupBy("_left", "_right").count().sortWithinPartitions("_left", "_right")).select("_left", "_right", "_name"), "names")
    return pairs.join(names, ["_left", "_right"]).select("_row", "_blocks", "_at", "_name"), names


def exact_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """df without its text, with keep_id, group_size, kept and text_sha256; one row for each row of df.

    Texts are equal when all their bytes are; a null one is empty. Of equal texts, the row with the largest doc_id
    stays (keep_id, kept); a null doc_id is the least, and of rows that repeat the largest one stays. Where all ids of
    a group are null, keep_id is null and one row stays. An empty table gives an empty one. Columns of df
    named as the new or inner ones are replaced.
    """
    spark, new = df.sparkSession, ("keep_id", "group_size", "kept", "text_sha256")
    keep = [c for c in df.columns if c not in (text, *new, *_INNER)]
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    parts = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda i: F.substring(F.col("_block"), i * block + 1, F.lit(block)))
    read = df.select(*keep, content.alias("_block")).withColumns({"_row": F.monotonically_increasing_id(), "_sha": F.sha2("_block", 256), "_blocks": F.greatest(F.lit(1), F.ceil(F.octet_length("_block") / block)).cast("int")})
    cut = read.select(*keep, "_sha", "_row", "_blocks", F.posexplode(parts).alias("_at", "_part"))
    head = lambda c: F.when(F.col("_at") == 0, F.col(c)).alias(c)  # noqa: E731  the columns of a row stand at its first block
    blocks = cut.select(*[head(c) for c in keep], head("_sha"), "_row", "_blocks", "_at", F.col("_part").alias("_block"), _hash(F.col("_part")).alias("_hash"))
    blocks = stage(blocks, "blocks")

    named, used = _first_names(blocks)
    most, levels, done = blocks.agg(F.max("_blocks")).first()[0] or 1, 0, []
    tables = [used]
    while most > 1:
        named = stage(named, "named")
        tables.append(named)
        done.append(named.where("_blocks = 1").withColumn("_level", F.lit(levels)))
        named, used = _pair(named.where("_blocks > 1"))
        tables.append(used)
        most, levels = (most + 1) // 2, levels + 1
    last = named.withColumn("_level", F.lit(levels))
    for each in done:
        last = last.unionByName(each)

    rows = blocks.where("_at = 0").select(*keep, "_row", "_sha")
    whole = stage(rows.join(last.select("_row", "_level", "_name"), "_row"), "identities")
    for x in (*tables, blocks):
        drop(spark, x)
    best = F.max(F.struct(F.col(doc_id).alias("id"), F.col("_row").alias("row")))
    groups = stage(whole.groupBy("_level", "_name").agg(best.alias("_best"), F.count("*").alias("group_size")), "groups")
    return whole.join(groups, ["_level", "_name"]).select(*keep, F.col("_best.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best.row")).alias("kept"), F.col("_sha").alias("text_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

QUERIES = {"op13_exact_dedup": op13_exact_dedup}
SQL = {"op13_exact_dedup": _SQL}
