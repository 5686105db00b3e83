"""Operators that SQL can't express, against brute force, round trips or held-out labels."""

import gzip
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from test_llm_leaks import passes, template

from tessera.llm import decontamination, line_dedup, mixing, ngram_jaccard, quality_classifier, quality_rules, substring_dedup, warc


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(texts: dict, n: int, percent: int) -> dict:
    sets, least = {i: shingles(t, n) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((top(a), top(b)))
                least[q] = p
    return {i: top(i) for i in ids}


def mutated(words, rng, share):
    return [rng.choice(("new", "other", "word")) + str(rng.randrange(99)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_components(spark, n, percent):
    rng, texts = random.Random(n), {}
    for g in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((4, 20, 90, 400)))]
        for _ in range(6):
            texts[rng.randrange(10**9)] = " ".join(mutated(base, rng, rng.choice((0, 0.005, 0.01, 0.02, 0.1))))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: r.component_id for r in ngram_jaccard.jaccard_components(df, n=n, percent=percent).collect()}
    assert got == components(texts, n, percent)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
def test_common_words(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    assert substring_dedup.common_words(np.array(a, int), np.array(b, int)) == t[-1, -1]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(1, 9)), min_size=1, max_size=25))
def test_best_chain(found):
    f = np.array(sorted({(i, i + n, j, j + n) for i, j, n in found}))
    score = {}
    for k in range(len(f)):
        gaps = [score[x] - 0.25 * (f[k, 0] + f[k, 2] - f[x, 1] - f[x, 3]) for x in range(k) if f[x, 0] < f[k, 0] and f[x, 2] < f[k, 2]]
        score[k] = f[k, 1] - f[k, 0] + max([0, *gaps])
    first = substring_dedup.chains(f, max_gap=10**6)[0]
    own = sum(r[1] - r[0] for r in first) - 0.25 * sum((y[0] - x[1]) + (y[2] - x[3]) for x, y in zip(first, first[1:], strict=False))
    assert own == pytest.approx(max(score.values()))
    assert sorted(map(tuple, np.concatenate(substring_dedup.chains(f)))) == sorted(map(tuple, f))


def test_passages(spark):
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    exact, fuzzy, texts, holds = prose(55), prose(120), [], set()
    for i in range(60):
        p = {0: exact, 1: mutated(fuzzy, rng, 0.05)}.get(i % 4)
        texts.append((i, " ".join(prose(rng.randrange(30, 300)) + (p or prose(40)) + prose(rng.randrange(30, 300)))))
        if p:
            holds.add(i)
    got = substring_dedup.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == holds
    assert all(r.end - r.start >= 50 and 100 * r.matched >= 80 * (r.end - r.start) for r in got)
    words = {i: t.split() for i, t in texts}
    assert all(exact == words[r.doc_id][r.start : r.end][:55] for r in got if r.doc_id % 4 == 0 and r.end - r.start == 55)


def test_every_long_repeat_is_found(spark, small):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    own: dict = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        for k in range(len(w) - 49):
            own.setdefault(tuple(w[k : k + 50]), set()).add(i)
    wanted = {i for s in own.values() if len(s) > 1 for i in s}
    assert wanted <= {r.doc_id for r in substring_dedup.op3_substring_dedup(spark, small).collect()}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_classifier.op2_quality_classifier(spark, sf).toPandas()
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df()
    x = got[got.held_out].merge(labels, on="doc_id")
    assert got.score.between(0, 1).all() and len(got) == 1000
    assert (x.predicted == x.quality).mean() >= max(0.8, x.quality.mean(), 1 - x.quality.mean())


def test_scores_equal_a_plain_discriminant(spark, small):
    got = {r.doc_id: r.score for r in quality_classifier.op2_quality_classifier(spark, small).collect()}
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall())
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{small}/labels.parquet'").fetchall()
    x = {i: quality_classifier.statistics(t) for i, t in docs.items()}
    known = {c: np.array([x[i] for i, q in labels if q == c and zlib.crc32(str(i).encode()) % 3 != 1]) for c in (0, 1)}
    total = sum(map(len, known.values()))
    pooled = sum((len(v) - 1) * np.cov(v.T) for v in known.values()) / (total - 2)
    log = {}
    for c, v in known.items():
        cov = 0.9 * np.cov(v.T) + 0.1 * pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
        d = np.array(list(x.values())) - v.mean(0)
        log[c] = np.log(len(v) / total) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    z = log[1] - log[0]
    want = dict(zip(x, 0.5 + 0.5 * z / (1 + np.abs(z)), strict=True))
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in got)


def test_templates(spark):
    item = "A train leaves Boston at 9 am and travels 120 km in 2 hours before it meets Alice , how many km does it travel per hour"
    docs = [
        (1, "noise before . " + item + " and noise after"),
        (2, item.replace("120", "360").replace("Boston", "Paris").replace("Alice", "Bob").replace(" 2 ", " 4 ")),
        (3, item.replace("Alice", "Boston")),
        (4, "A plain text about trains that leaves nothing to be found in any benchmark at all , by any means"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.exact) for r in decontamination.find_leaks(df, bench).collect()}
    assert (1, True) in got and (2, False) in got and 4 not in {d for d, _ in got}
    assert (3, False) in got  # a stretch without one of the two names is consistent
    assert {r.doc_id for r in decontamination.decontaminate(df, bench).collect()} == {4}


def test_inconsistent_slots(spark):
    item = "First Alice gave Bob an apple , then Bob gave Cara a pear , then Cara gave Alice a plum"
    one_to_one = item.replace("Alice", "Xena").replace("Bob", "Yves").replace("Cara", "Zoe")
    mixed_up = "First Xena gave Xena an apple , then Yves gave Yves a pear , then Zoe gave Zoe a plum"
    df = spark.createDataFrame([(1, one_to_one), (2, mixed_up)], "doc_id long, text string")
    got = decontamination.find_leaks(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1}


def test_whole_items_are_found(spark, small):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{small}/benchmark.parquet'").fetchall()]
    wanted = {i for i, t in docs if t and any(x in t for x in items)}
    assert wanted <= {r.doc_id for r in decontamination.op10_decontamination(spark, small).collect()}


def test_salvage_logs_gaps():
    body = [b"a" * 200, b"b" * 300, b"c" * 10]
    recs = [gzip.compress(warc.record(i, "http://x", hashlib.sha256(b).hexdigest(), None, b)) for i, b in enumerate(body)]
    whole = b"".join(recs)
    assert [x[4] for x in warc.salvage(whole)] == body
    hurt = bytearray(whole)
    hurt[len(recs[0]) + 30] ^= 0xFF
    got = list(warc.salvage(bytes(hurt)))
    assert [x[4] for x in got if x[2] is None] == [body[0], body[2]]
    assert [(x[0], x[1]) for x in got if x[2]] == [(len(recs[0]), len(recs[0]) + len(recs[1]))]
    plain = b"".join(warc.record(i, None, hashlib.sha256(b).hexdigest(), None, b) for i, b in enumerate(body))
    at = plain.index(b"aaaa") + 50
    cut = plain[:at] + b"junk" + plain[at:]
    assert [x[4] for x in warc.salvage(cut) if x[2] is None] == body[1:]
    cut = list(warc.salvage(whole[:-5]))  # only the last member's trailer is cut: its record is whole
    assert [x[4] for x in cut if x[2] is None] == body and [x[0] for x in cut if x[2]] == [len(whole) - len(recs[2])]
    assert [x[4] for x in warc.salvage(whole[: len(recs[0]) + len(recs[1]) + 40]) if x[2] is None] == body[:2]


def test_pipeline(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    good = {i for (i,) in con.execute(f"SELECT doc_id FROM ({quality_rules.SQL['op9_quality_rules']}) WHERE kept").fetchall()}
    docs = {i: (t, s) for i, t, s in con.execute("SELECT doc_id, text, source FROM documents").fetchall() if i in good}
    strip = lambda x: x.strip(" \t\x0b\f\r")
    pages, held = {}, {}
    for t, s in docs.values():
        pages[s] = pages.get(s, 0) + 1
        for x in {strip(x) for x in t.split("\n")} - {""}:
            held[s, x] = held.get((s, x), 0) + 1
    drop = {k for k, n in held.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    texts = {i: "\n".join(x for x in t.split("\n") if (s, strip(x)) not in drop) for i, (t, s) in docs.items()}
    least = components(texts, 5, 80)
    texts = {i: t for i, t in texts.items() if least[i] == i}
    items = [template(t) for (t,) in con.execute(f"SELECT text FROM '{small}/benchmark.parquet'").fetchall()]
    runs = lambda x: {tuple(w[0] for w in x[i : i + 6]) for i in range(len(x) - 5)} | {tuple(w[1] for w in x[i : i + 6]) for i in range(len(x) - 5)} | {x[i + 1][0] for i in range(min(1, len(x) - 1))}
    known = [(x, runs(x)) for x in items]
    leaks = set()
    for i, t in texts.items():
        x = template(t)
        have = runs(x) | {w[0] for w in x}
        if any(have & r and passes(x, item) for item, r in known):
            leaks.add(i)
    mix = corpus_pipeline.run(spark, small).toPandas()
    assert {(i, t) for i, t in zip(mix.doc_id, mix.text, strict=True)} <= {(i, t) for i, t in texts.items() if i not in leaks}
    left = pd.DataFrame([(i, t, docs[i][1]) for i, t in texts.items() if i not in leaks], columns=["doc_id", "text", "source"])
    con.execute("DROP VIEW documents")
    con.register("documents", left)
    want = {i: n for i, n in con.execute(f"SELECT doc_id, taken FROM ({mixing.SQL['op6_mixing']}) WHERE taken > 0").fetchall()}
    assert mix.groupby("doc_id")["size"].sum().to_dict() == want
    sizes = {i: len(t.encode().split()) for i, t in texts.items() if i not in leaks}
    one = mix.drop_duplicates("source")
    assert one.source_size.sum() == sum(sizes.values())
    taken = mix.groupby("source")["size"].sum()
    for _, r in one.iterrows():
        assert abs(taken[r.source] - r.target) <= 2 * max(sizes.values())
    assert mix.groupby("doc_id").size().max() <= 2
