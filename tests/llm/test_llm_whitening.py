"""Whitening against a dense eigensolver, the iteration on hard spectra, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import whitening

TABLE = "embeddings"


def dense(vectors, components=16):
    """vec_id -> (deviation, whitened), and explained, with exact sums and numpy's eigensolver."""
    x = {k: [math.floor(64 * float(c)) + 1_000_000 for c in v] for k, v in vectors.items()}
    fit = [list(v) for v in {tuple(v) for v in x.values()}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = lambda v: np.array([(n * c - s) / n for c, s in zip(v, sums, strict=True)])
    z = np.array([centred(v) for v in fit])
    values, u = np.linalg.eigh(z.T @ z / n)
    values, u = values[::-1][:components], u[:, ::-1][:, :components]
    return {k: (sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), centred(v) @ u / np.sqrt(values)) for k, v in x.items()}, values / ((z**2).sum() / n), n


def close(a, b):
    """Equal up to the sign of each column."""
    signs = np.sign((a * b).sum(0))
    assert np.abs(a * signs - b).max() < 1e-8


def test_against_dense(spark, small):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{small}/{TABLE}.parquet").collect()}
    wanted, shares, n = dense(vectors)
    got = {}
    for r in whitening.op12_whitening(spark, small).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(wanted) and all(set(c) == set(range(1, 17)) for c in got.values())
    assert all(c[1].deviation == wanted[k][0] and c[1].n == n for k, c in got.items())
    close(np.array([[got[k][j].whitened for j in range(1, 17)] for k in sorted(got)]), np.array([wanted[k][1] for k in sorted(got)]))
    one = got[min(got)]
    assert np.allclose([one[j].explained for j in range(1, 17)], shares, rtol=1e-9) and one[1].identity_error < 1e-9


@pytest.mark.parametrize("spectrum", [[*range(40, 0, -1)], [5.0] * 20 + [1.0] * 30, [3.0, 2.0, 1.0] + [0.0] * 37, [1.0 + 1e-9 * k for k in range(40)], [2.0**-k for k in range(60)], [1.0]])
@pytest.mark.parametrize("limit", [512, 40])
def test_hard_spectra(spectrum, limit):
    d = len(spectrum)
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((d, d)))
    v = q @ np.diag(spectrum) @ q.T
    values, vectors, told = whitening.lanczos(lambda b: v @ b, d, 16, limit=limit)
    k = min(16, d)
    assert np.allclose(values, sorted(spectrum, reverse=True)[:k], atol=1e-12 * max(spectrum))
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * max(spectrum) and told["turns"] < 200


def test_many_dimensions_restart():
    d = 600
    values = np.sort(np.random.default_rng(5).random(d) ** 4)[::-1]
    got, vectors, told = whitening.lanczos(lambda b: values[:, None] * b, d, 16, limit=64)
    assert told["restarts"] > 0 and np.allclose(got, values[:16], atol=1e-12) and np.abs(np.abs(vectors[:16]) - np.eye(16)).max() < 1e-6


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2, 0.3]), (2, [0.1, 0.2, 0.3]), (3, [0.5, -0.2, 0.9]), (None, [0.9, 0.9, 0.1]), (4, None), (5, [0.1, None, 0.2]), (6, [0.1, nan, 0.2]), (7, [inf, 0.1, 0.2]), (8, []), (9, [0.1]), (10, [0.2, 0.1, -0.7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit("x").alias("n"), F.lit("y").alias("component"))
    got, fitted = whitening.whiten(df)
    out = {r.vec_id: r for r in got.collect()}
    single = {k: np.float32(v).tolist() for k, v in rows if k in (None, 1, 2, 3, 10)}
    wanted, _, n = dense(single, 3)
    assert set(out) == set(wanted) and n == 4 and fitted["n"] == 4
    assert all(out[k].deviation == wanted[k][0] and out[k].n == 4 and out[k].component == "y" for k in wanted)
    close(np.array([out[k].whitened for k in wanted]), np.array([wanted[k][1] for k in wanted]))
    for part in (df.where("false"), df.where("vec_id IN (4, 5, 8)"), df.where("vec_id IN (1, 2)")):
        left, fitted = whitening.whiten(part)
        assert all(r.whitened == [] for r in left.collect()) and len(fitted["values"]) == 0


def test_numbers_beyond_64_bits(spark):
    rows = [(k, [float(10**15 * k), float(k % 3), 3e38 if k == 5 else 0.0]) for k in range(8)]
    got, fitted = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").where("vec_id <> 5"))
    wanted, _, _ = dense({k: v for k, v in rows if k != 5}, 2)
    assert {r.vec_id: int(r.deviation) for r in got.collect()} == {k: w[0] for k, w in wanted.items()}
    with_huge, _ = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.vec_id for r in with_huge.collect() if r.deviation is None} == {5} and with_huge.count() == 8
