"""Block naming: equal texts, hashes that clash, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup


def brute(rows):
    """(doc_id, keep_id, group_size) of each row, by comparing texts."""
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    best = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return sorted(((d, best[t or ""], len(groups[t or ""])) for d, t in rows), key=str)


def found(df, block=exact_dedup.BLOCK):
    out = exact_dedup.exact_duplicates(df, block=block).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size) for r in out), key=str), out


def texts(seed):
    """Texts of few pieces, so that many share blocks, halves and lengths."""
    r = random.Random(seed)
    some = ["".join(r.choice(["abcd", "abce", "éa", "\U0001f600"]) for _ in range(r.choice([0, 1, 2, 3, 5, 8, 13]))) for _ in range(60)]
    return [(k, r.choice(some)) for k in range(300)] + [(300, None), (301, "x" * 5000), (302, "x" * 5000), (303, "x" * 4999 + "y")]


@pytest.mark.parametrize("weak", [False, True])
def test_against_comparison(spark, monkeypatch, weak):
    if weak:  # three values for all blocks: names must still tell them apart
        monkeypatch.setattr(exact_dedup, "_hash", lambda b: (F.octet_length(b) % 3).cast("bigint"))
    rows = texts(1)
    got, out = found(spark.createDataFrame(rows, "doc_id long, text string"), block=7)
    assert got == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)


def test_odd_rows(spark):
    rows = [(1, "a", "p"), (1, "a", "p"), (None, "a", "q"), (2, None, "q"), (3, "", None), (None, "b", "r"), (None, "b", "r"), (4, " ", "r"), (5, "A", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").select("*", *[F.lit("x").alias(c) for c in ("keep_id", "_row", "_name", "_hash", "group_size", "extra")])
    got, out = found(df)
    assert got == brute([r[:2] for r in rows])
    assert sum(r.kept for r in out) == 5 and {r.extra for r in out} == {"x"}
    assert found(df.where("false"))[0] == []
    assert {r.text_sha256 for r in out if r.doc_id in (2, 3)} == {"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
