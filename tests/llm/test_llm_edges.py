"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator."""

import uuid

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, license_scan, line_dedup, mixing, ngram_jaccard, quality_classifier, quality_rules, secret_scan, substring_dedup, warc
from tessera.llm.common import shared_dir

LONG = " ".join(f"word{i % 977} token{i}" for i in range(20_000))
ROWS = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \n\t ", "en", None, 4), (None, "x y z x y z", "en", "s", 11), (5, LONG, "de", "t", len(LONG)), (6, LONG, "de", "t", len(LONG)), (7, "naïve \U0001f600 text\x00 here", "fr", "t", 20)]
EXTRA = ("n_words", "kept", "spans", "size", "copies", "target", "score", "node", "start", "_base", "_boiler", "n_lines", "id", "rank")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in EXTRA])


def _warc(df):
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    path = f"{shared_dir(df.sparkSession)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(pages, path)
    return warc.read_warc(df.sparkSession, path)


def _leaks(df):
    return decontamination.decontaminate(df, df.select(F.col("doc_id").alias("item_id"), "text"))


def _classify(df):
    x = quality_classifier.with_statistics(df)
    return quality_classifier.score(x, quality_classifier.fit(x.withColumn("label", F.col("doc_id") % 2)))


CASES = {
    "quality_rules": (quality_rules.quality_rules, 9),
    "line_dedup": (line_dedup.line_dedup, 9),
    "mixing": (lambda d: mixing.mix_sources(mixing.with_size(d)), 9),
    "license": (license_scan.license_scan, 9),
    "secrets": (secret_scan.secret_scan, 9),
    "classifier": (_classify, 9),
    "jaccard": (ngram_jaccard.jaccard_components, 9),
    "warc": (_warc, 9),
    "leaks": (_leaks, 3),
    "passages": (substring_dedup.repeated_passages, 2),
}


@pytest.mark.parametrize("name", CASES)
def test_odd_rows(docs, name):
    f, n = CASES[name]
    assert len(f(docs).collect()) == n


@pytest.mark.parametrize("name", CASES)
def test_empty_table(docs, name):
    assert CASES[name][0](docs.where("false")).collect() == []


def test_values(docs):
    j = {(r.id, r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(docs, n=3, percent=90).collect()}
    assert {(1, 4, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (7, 2, 7)} <= j and (None, 3, None) in j
    assert {r[2] for r in j if r[0] in (5, 6)} == {5}
    assert all(not r.kept for r in quality_rules.quality_rules(docs).where("doc_id <= 4").collect())
    p = substring_dedup.repeated_passages(docs).collect()
    assert {(r.doc_id, r.start, r.end, r.partner_id, r.matched) for r in p} == {(5, 0, 40_000, 6, 40_000), (6, 0, 40_000, 5, 40_000)}


def test_values_of_the_others(docs):
    by = lambda rows, key="doc_id": {r[key]: r for r in rows}
    lic = by(license_scan.license_scan(docs).collect())
    assert all(r.sentence_ids == [] and r.licenses == [] and r.n_unmatched == 0 for r in lic.values())
    sec = by(secret_scan.secret_scan(docs).collect())
    assert all(r.spans == [] for r in sec.values())
    lines = by(line_dedup.line_dedup(docs).collect())
    assert (lines[2].text, lines[2].n_lines, lines[3].text, lines[3].n_lines, lines[4].n_lines, lines[None].n_dropped) == (None, 0, "", 1, 2, 0)
    mix = [(r.doc_id, r["size"], r.source) for r in mixing.mix_sources(mixing.with_size(docs)).collect()]
    assert sorted(mix, key=str) == sorted([(1, 6, "s"), (1, 6, "s"), (2, 0, None), (3, 0, "s"), (4, 0, None), (None, 6, "s"), (5, 40_000, "t"), (6, 40_000, "t"), (7, 4, "t")], key=str)
    counts = by(quality_rules.quality_rules(docs).collect())
    assert (counts[2].n_words, counts[4].n_words, counts[5].n_words, counts[None].n_repeat_words, counts[7].word_chars) == (0, 0, 40_000, 6, 15)
    scores = _classify(docs).collect()
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in scores) and len({r.score for r in scores if r.doc_id == 1}) == 1
    warc_rows = [(r.record_id, r.type, r.payload_bytes) for r in _warc(docs).collect()]
    assert sorted(x[1] for x in warc_rows) == ["response"] * 8 + ["revisit"] and ("<urn:page:2>", "response", 0) in warc_rows and ("<urn:page:>", "response", 11) in warc_rows
    assert sorted(str(r.doc_id) for r in _leaks(docs).collect()) == ["2", "3", "4"]


def test_contradicting_labels_count_each(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "x x x x"), (3, "a b d"), (4, "y y y y")], "doc_id long, text string")
    x = quality_classifier.with_statistics(df).crossJoin(spark.createDataFrame([(0,), (1,), (None,), (7,)], "label int"))
    assert {r.score for r in quality_classifier.score(quality_classifier.with_statistics(df), quality_classifier.fit(x)).collect()} == {0.5}


def test_words_of_other_kinds_of_ids(spark):
    rows = [("b", "one two three four five six seven"), ("a", "one two three four five six seven"), ("c", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r.id: r.component_id for r in ngram_jaccard.jaccard_components(df).collect()} == {"a": "a", "b": "a", "c": "c"}
