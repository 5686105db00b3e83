"""The pipeline as a whole over nulls, repeated ids, long texts, clashing columns and empty tables."""

import tempfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.quality_rules import quality_rules

def written(docs, bench):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs.write.parquet(f"{path}/documents.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def prose(spark, small):
    kept = quality_rules(spark.read.parquet(f"{small}/documents.parquet").where("n_chars BETWEEN 600 AND 3000")).where("kept")
    return [r.text for r in kept.orderBy("doc_id").limit(3).collect()]


@pytest.fixture
def docs(spark, prose):
    one, two, three = prose
    long = two + "\n" + " ".join(f"word{k} and term{k * 7}" for k in range(20_000))
    rows = [(1, one, "en", "s", 1), (1, one, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, one + " tail", "en", None, 9), (None, three, "en", "s", 9), (5, long, "de", "t", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in ("kept", "size", "n_words", "_leak", "_kept", "id")])


def bench(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_odd_rows(spark, docs):
    out = corpus_pipeline.run(spark, written(docs, bench(spark, None, "", "a question that nobody asked about the river and its seven old bridges today")))
    rows = out.collect()
    assert {r.doc_id for r in rows} <= {1, None, 5} and rows and all(r.text for r in rows)
    again = sorted((str(r.doc_id), r.copy) for r in corpus_pipeline.run(spark, written(docs, bench(spark))).collect())
    assert again == sorted((str(r.doc_id), r.copy) for r in rows)


def test_empty_tables(spark, docs, prose):
    assert corpus_pipeline.run(spark, written(docs.where("false"), bench(spark))).collect() == []
    leaks = corpus_pipeline.run(spark, written(docs.where("doc_id = 1"), bench(spark, prose[0])))
    assert leaks.collect() == []
