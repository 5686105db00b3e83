"""Running aggregates in both ways, and reviews of results on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup, reviews


@pytest.mark.parametrize("how", [F.max, F.sum])
def test_running_is_the_same_in_one_window_and_over_ranges(spark, monkeypatch, how):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", None]), k, r.choice([None, *range(50)])) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(7)
    got = lambda: sorted(map(tuple, dedup.running(df, "k", "at", "v", how).collect()), key=str)
    whole = got()
    monkeypatch.setattr(dedup, "WHOLE_KEY", 3)
    assert got() == whole
    seen, wanted = {}, []
    for k, at, v in rows:
        before = [x for x in seen.get(k, []) if x is not None]
        wanted.append((k, at, v, (max(before) if how is F.max else sum(before)) if before else None))
        seen.setdefault(k, []).append(v)
    assert whole == sorted(wanted, key=str)


def test_validators_without_cases_and_with_two(spark):
    records = spark.createDataFrame([("a", 'puts("Hello"); while'), ("b", None), ("c", "x")], "id string, code string")
    cases = spark.createDataFrame([("a", ["WHILE", "for"], ["hello", "bye"], 1), ("a", [], [], 2), ("b", ["x"], [], 1), ("z", [], [], 1)], "id string, keywords array<string>, tokens array<string>, n int")
    got = {r.id: (r.ok, r.score, r.missing, r.note) for r in reviews.keyword_validation(records, cases, "n").collect()}
    assert got == {"a": (True, 0.5, ["for", "bye"], None), "b": (True, 0.5, ["x"], None), "c": (False, 0.0, [], "no case")}
    runs = spark.createDataFrame([("a", True, "HELLO"), ("b", False, "bye")], "id string, ran boolean, output string")
    some = cases.where("n = 1").select("id", "tokens")
    ran = {r.id: (r.ok, r.ratio, r.missing, r.note) for r in reviews.runtime_validation(records.select("id"), runs, some).collect()}
    assert ran == {"a": (True, 0.5, ["bye"], None), "b": (False, 1.0, [], None), "c": (False, 0.0, [], "no executable")}


def test_no_verified_golden_keeps_all(spark):
    goldens = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    manifest = lambda *rows: spark.createDataFrame(list(rows), "id string, compile_verified boolean, runtime_verified boolean")
    assert reviews.verified_only(goldens, manifest(("a", True, False), ("b", None, True))).count() == 2
    assert [r.id for r in reviews.verified_only(goldens, manifest(("a", True, True), ("a", True, True))).collect()] == ["a"]


def test_promotion_verdicts(spark):
    of = lambda *states: reviews.promotion_summary(spark.createDataFrame([(s, None) for s in states], "status string, tier string")).first().verdict
    assert (of(), of("approved", "approved"), of("approved", None), of("rejected")) == ("empty", "pass", "partial", "partial")


def test_best_before_counts_earlier_stamps_only(spark):
    runs = spark.createDataFrame([("a", True, 1, 3), ("b", True, 1, 9), ("c", False, 2, 50), ("d", True, 3, 4), ("e", False, 0, 7)], "run string, strict boolean, stamp int, accepted int")
    assert {r.run: r.best_before for r in reviews.best_before(runs, "strict", "stamp", "accepted").collect()} == {"a": None, "b": None, "c": 9, "d": 9, "e": None}
