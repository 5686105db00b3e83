"""Archives: damage inside members of several records, byte round trip, repeated ids."""

import gzip
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.llm.common import shared_dir

BODIES = [b"a" * 200, bytes(range(256)) * 2, b"c" * 10]


def records():
    return [warc.record(i, "http://x", hashlib.sha256(b).hexdigest(), None, b) for i, b in enumerate(BODIES)]


def bodies(data):
    return [x[4] for x in warc.salvage(data) if x[2] is None]


def test_damaged_record_inside_a_member():
    recs = records()
    recs[1] = recs[1].replace(b"\x10\x11\x12", b"\x10\x13\x12", 1)
    whole = gzip.compress(b"".join(recs))
    got = list(warc.salvage(whole))
    assert [x[4] for x in got if x[2] is None] == [BODIES[0], BODIES[2]]
    [gap] = [x for x in got if x[2]]
    assert gap[:2] == (0, len(whole)) and f"bytes {len(recs[0])} to {len(recs[0]) + len(recs[1])}" in gap[2]


def test_cut_member():
    whole = gzip.compress(b"".join(records()))
    got = list(warc.salvage(whole[:-9]))
    assert [x[4] for x in got if x[2] is None][:2] == BODIES[:2] and any(x[2] for x in got)
    noise = random.Random(1).randbytes(70_000)
    recs = [warc.record(i, None, hashlib.sha256(b).hexdigest(), None, b) for i, b in enumerate([b"x" * 300, noise, b"y"])]
    one, next_ = gzip.compress(b"".join(recs)), gzip.compress(warc.record(9, None, hashlib.sha256(b"z").hexdigest(), None, b"z"))
    assert bodies(one[: len(one) // 2] + next_) == [b"x" * 300, b"z"]


def test_wrong_checksum_keeps_the_records():
    whole = bytearray(gzip.compress(b"".join(records())))
    whole[-6] ^= 0xFF
    got = list(warc.salvage(bytes(whole)))
    assert [x[4] for x in got if x[2] is None] == BODIES and [x[:2] for x in got if x[2]] == [(0, len(whole))]


@pytest.mark.parametrize("seed", range(20))
def test_any_one_flipped_byte_loses_no_other_member(seed):
    rng = random.Random(seed)
    parts = [gzip.compress(x) for x in records()]
    k = rng.randrange(3)
    hurt = bytearray(parts[k])
    hurt[rng.randrange(len(hurt))] ^= 1 << rng.randrange(8)
    got = bodies(b"".join(bytes(hurt) if i == k else p for i, p in enumerate(parts)))
    assert [b for i, b in enumerate(BODIES) if i != k] == [b for b in got if b != BODIES[k]]


def _written(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/warc-{random.random()}"
    warc.write_warc(df, path)
    return warc.read_warc(spark, path)


def test_every_byte_comes_back(spark):
    text = "".join(map(chr, range(1, 0x250))) + "\U0001f600\r\n\r\nWARC/1.1\r\n"
    [r] = _written(spark, [(1, "http://x/\r\nä", text)]).collect()
    assert bytes(r.payload) == text.encode() and r.payload_digest == r.header_digest and r.gap is None


def test_revisits_of_an_id_with_two_payloads(spark, monkeypatch):
    x, y = "x" * 300, "y" * 400
    df = spark.createDataFrame([(1, None, x), (1, None, y), (2, None, x), (3, None, y), (4, None, None), (5, None, "")], "page_id long, url string, html string")
    monkeypatch.setattr(warc, "table", lambda *_: df)
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op5_warc(spark, "").collect()}
    of = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {(1, 300, of(x), "response", None), (1, 400, of(y), "response", None), (2, 300, of(x), "revisit", 1), (3, 400, of(y), "revisit", 1)}
    assert got == want | {(k, 0, of(""), "response", None) for k in (4, 5)}


def test_large_files_fail_loudly(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_FILE_BYTES", 10)
    with pytest.raises(Exception, match="over 10 bytes"):
        _written(spark, [(1, None, "a")]).select(F.col("file")).collect()


def test_long_damaged_regions_take_seconds():
    """Time grows with the bytes: a megabyte of version lines, thousands of cut members, both between good records."""
    first, last = (gzip.compress(r) for r in records()[:2])
    for middle in (b"WARC/1.1\r\n" * 100_000, b"WARC/1.1\r\na: b\r\n" * 60_000, b"".join(gzip.compress(records()[0])[:150] for _ in range(4000)), b"\x1f\x8b\x08\0" * 100_000):
        began = time.perf_counter()
        assert bodies(first + middle + last) == BODIES[:2]
        assert time.perf_counter() - began < 20


def test_a_bomb_is_quarantined(monkeypatch):
    monkeypatch.setattr(warc, "MAX_MEMBER_BYTES", 1 << 20)
    first, last = (gzip.compress(r) for r in records()[:2])
    bomb = gzip.compress(records()[2] + bytes(1 << 26))
    got = list(warc.salvage(first + bomb + last))
    assert [x[4] for x in got if x[2] is None] == [BODIES[0], BODIES[2], BODIES[1]]
    assert any(x[2] and "over 1048576 bytes" in x[2] for x in got)


def test_text_ids(spark, monkeypatch):
    rows = [("", "x" * 200), (None, "x" * 200), ("a\r\nb", "y" * 200), ("%>", "z"), ("c d", "y" * 200)]
    df = spark.createDataFrame([(i, None, t) for i, t in rows], "page_id string, url string, html string")
    monkeypatch.setattr(warc, "table", lambda *_: df)
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.op5_warc(spark, "").collect()}
    assert got == {("", "response", None), (None, "revisit", ""), ("a\r\nb", "response", None), ("c d", "revisit", "a\r\nb"), ("%>", "response", None)}
