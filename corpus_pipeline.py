"""The corpus pipeline: five stages over documents, each written and read again.

Every stage but the last returns the columns of documents; the last returns the mix, one row per
copy. A stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stage, table
from tessera.llm.decontamination import decontaminate
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import emit, mix_sources, with_size
from tessera.llm.ngram_jaccard import jaccard_components
from tessera.llm.quality_rules import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).where("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines; n_chars follows the text."""
    out = line_dedup(docs)
    return out.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one
    with the smallest doc_id; of rows that repeat that id, one. Documents without an id stay."""
    groups = jaccard_components(docs, n=5, percent=80).where("id = component_id").select(F.col("id").alias("doc_id")).distinct()
    named = docs.where("doc_id IS NOT NULL").join(groups, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id IS NULL"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents' columns with size, source_size, target, copies, and copy (1 to copies)."""
    return emit(mix_sources(with_size(docs)))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", leaks),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near-duplicate groups need a closure over links, which the SQL check can't run on whole tables.
ORACLE_SQL = None
