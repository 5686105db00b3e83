"""Embedding whitening by a matrix-free block Lanczos iteration.

Vectors become whole numbers x, each distinct one is fitted once, and the covariance is never formed: a turn of the
iteration is one pass over the vectors, in which every task centres its rows, multiplies them with the block and
sends back a product of dimensions x block. The driver holds the basis and its products (bounded by the dimension, not
by the rows), makes each new block orthogonal to the whole basis, twice, fills directions that break down with
random ones, and stops when the residuals of the wanted components, which it has without a further pass, are
small or the basis spans the space. A basis that grows past its limit is restarted from its best Ritz vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, LongType, StructType

from .common import stage, table

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: A residual of so many times the largest eigenvalue is small; an eigenvalue below RANK times it counts as zero.
TOLERANCE, RANK = 1e-13, 1e-12
#: Basis vectors kept before a restart, and turns at most.
BASIS, TURNS, SEED = 512, 200, 11
#: Whole numbers up to here are multiplied as 64-bit ones; beyond, as Python's, which have no bound.
_SAFE = 2**62


def whole(vector: Column) -> Column:
    """floor(SCALE * c) + SHIFT of each entry, as long; what is beyond 2 ** 62 stops there."""
    within = lambda c: F.least(F.greatest(F.floor(F.lit(float(SCALE)) * c.cast("double")), F.lit(-_SAFE)), F.lit(_SAFE))
    return F.transform(vector, lambda c: within(c) + SHIFT)


def usable(vector: Column) -> Column:
    """Neither null nor with an entry that is null or not finite."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def _rows(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)


def _deviations(x: np.ndarray, n: int, sums: list[int], safe: bool) -> np.ndarray:
    """n * x - S, exactly."""
    return n * x - np.array(sums, dtype=np.int64) if safe else n * x.astype(object) - np.array(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: list[int], safe: bool) -> np.ndarray:
    return (_deviations(x, n, sums, safe) / n).astype(np.float64)


def _summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of part(rows), a matrix of that shape. Each task adds up its own rows and sends one array."""
    d, size = len(fit.first()["x"]), shape[0] * shape[1]
    schema = pa.schema([pa.field("at", pa.int32()), pa.field("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(_rows(batch, "x", d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total.ravel())], schema=schema)

    added = fit.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for r in added.collect():  # dimensions x block numbers
        out[r.at] = r.value
    return out.reshape(shape)


def _orthogonal(block: np.ndarray, basis: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, int]:
    """Orthonormal columns, orthogonal to the basis, that span what block adds to it, and how many broke down: those
    are replaced by random directions. Fewer columns come back where the space is full."""
    out, broke = basis, 0
    for column in block.T:
        v, least = column, 1e-14 * np.linalg.norm(column)
        for attempt in range(3):
            if out.shape[1] == out.shape[0]:
                return out[:, basis.shape[1] :], broke
            for _ in range(2):
                v = v - out @ (out.T @ v)
            norm = np.linalg.norm(v)
            if norm > least:
                out = np.column_stack([out, v / norm])
                break
            broke += attempt == 0
            v, least = random.standard_normal(len(column)), 1e-6
    return out[:, basis.shape[1] :], broke


def lanczos(multiply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int | None = None, limit: int = BASIS, tolerance: float = TOLERANCE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, dict]:
    """The largest eigenvalues, falling, their unit eigenvectors as columns, and what it took (turns, restarts, broke).

    multiply gives the symmetric matrix times a block of columns. A block isn't smaller than wanted, so
    eigenvalues that repeat are found as often as they do.
    """
    random, block = np.random.default_rng(seed), min(d, max(wanted, block or wanted))
    limit, wanted = max(limit, 2 * block), min(wanted, d)
    basis = products = np.zeros((d, 0))
    q, _ = _orthogonal(random.standard_normal((d, block)), basis, random)
    told = {"turns": 0, "restarts": 0, "broke": 0}
    while True:
        made = multiply(q)
        told["turns"] += 1
        basis, products = np.column_stack([basis, q]), np.column_stack([products, made])
        small = basis.T @ products
        values, s = np.linalg.eigh((small + small.T) / 2)
        values, s = values[::-1], s[:, ::-1]
        vectors = basis @ s[:, :wanted]
        residuals = np.linalg.norm(products @ s[:, :wanted] - vectors * values[:wanted], axis=0)
        largest = max(abs(values[0]), abs(values[-1]))
        if basis.shape[1] == d or told["turns"] >= TURNS or basis.shape[1] >= wanted and residuals.max() <= tolerance * largest:
            return values[:wanted], vectors / np.linalg.norm(vectors, axis=0), told
        q, broke = _orthogonal(made, basis, random)
        told["broke"] += broke
        if basis.shape[1] + q.shape[1] > limit:
            kept = wanted + block // 2
            basis, products = basis @ s[:, :kept], products @ s[:, :kept]
            told["restarts"] += 1
            q, _ = _orthogonal(q, basis, random)


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, dict]:
    """df without rows whose vector can't be used, with n, deviation (decimal) and whitened (array of doubles, one for each
    component), and what was fitted: n, sums, values, vectors, explained, identity_error, turns, restarts, broke.

    A vector is left out if it is null or empty, holds a null or an entry that isn't finite, or has another length than most (of lengths
    as frequent, the largest one counts). Equal vectors are fitted once; every row gets its own values. Components are as many
    as asked for, at most those whose eigenvalue isn't zero: equal vectors alone give none. A deviation of more than 38 digits is null. An empty table gives an empty one. Columns of df named n, deviation, whitened or _x are replaced.
    """
    df = df.drop("n", "deviation", "whitened", "_x")
    rows = df.where(usable(F.col(vector)) & (F.size(vector) > 0)).withColumn("_x", whole(F.col(vector)))
    lengths = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    rows = rows.where(F.size("_x") == d)
    fit = stage(rows.select(F.col("_x").alias("x")).groupBy("x").count().select("x"), "vectors")

    exact = pa.schema([pa.field("at", pa.int32()), pa.field("total", pa.decimal128(38, 0)), pa.field("most", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = [0] * d, [0] * d
        for batch in batches:
            x = _rows(batch, "x", d)
            if len(x):
                most = [max(a, b) for a, b in zip(most, np.abs(x).max(0).tolist(), strict=True)]
                part = x.sum(0) if max(most) * len(x) < _SAFE else x.astype(object).sum(0)
                total = [a + b for a, b in zip(total, part.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0)), pa.array(most, pa.int64())], schema=exact)

    sums_of = fit.mapInArrow(add, "at int, total decimal(38,0), most bigint").groupBy("at").agg(F.sum("total").alias("total"), F.max("most").alias("most"))
    n, found = fit.count(), {r.at: r for r in sums_of.collect()}  # as many rows as dimensions
    sums = [int(found[k].total) for k in range(d)] if n else []
    safe = not n or n * max(r.most for r in found.values()) < _SAFE
    fitted = {"n": n, "sums": sums, "values": np.zeros(0), "vectors": np.zeros((d, 0)), "explained": np.zeros(0), "identity_error": 0.0, "turns": 0, "restarts": 0, "broke": 0}
    if n:
        centre = lambda x: _centred(x, n, sums, safe)
        trace = _summed(fit, lambda x: np.array([[(centre(x) ** 2).sum()]]), (1, 1))[0, 0] / n
        if trace > 0:

            def multiply(q: np.ndarray) -> np.ndarray:
                return _summed(fit, lambda x: (c := centre(x)).T @ (c @ q), q.shape) / n

            values, vectors, told = lanczos(multiply, d, components)
            real = values > RANK * max(values[0], trace / d)
            values, vectors = values[real], vectors[:, real]
            to = vectors / np.sqrt(values)
            gram = _summed(fit, lambda x: (w := centre(x) @ to).T @ w, (len(values), len(values))) / n
            fitted |= told | {"values": values, "vectors": vectors, "explained": values / trace, "identity_error": float(np.abs(gram - np.eye(len(values))).max())}
    to = fitted["vectors"] / np.sqrt(fitted["values"])
    one = d * (2 * n * max((r.most for r in found.values()), default=0)) ** 2 < _SAFE  # squares, too, fit in 64 bits

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, "_x", d)
            raw = _deviations(x, n, sums, safe)
            small = one or safe and (not raw.size or d * int(np.abs(raw).max()) ** 2 < _SAFE)
            squares = (raw**2).sum(1) if small else (raw.astype(object) ** 2).sum(1)
            w = (raw / n).astype(np.float64) @ to
            new = [pa.array([n] * len(x), pa.int64()), pa.array([Decimal(int(v)) if v < 10**38 else None for v in squares], pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))]
            kept = [k for k, name in enumerate(batch.schema.names) if name != "_x"]
            fields = [batch.schema.field(k) for k in kept] + [pa.field("n", pa.int64()), pa.field("deviation", pa.decimal128(38, 0)), pa.field("whitened", pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + new, schema=pa.schema(fields))

    out = StructType([*df.schema.fields]).add("n", LongType()).add("deviation", DecimalType(38, 0)).add("whitened", ArrayType(DoubleType()))
    return rows.mapInArrow(project, out), fitted


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fitted = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    shares = F.array(*[F.lit(float(v)) for v in fitted["explained"]]).cast("array<double>")
    each = rows.select("vec_id", "n", F.col("deviation").cast("bigint").alias("deviation"), F.posexplode("whitened").alias("_k", "whitened"))
    return each.select("vec_id", (F.col("_k") + 1).alias("component"), "n", "deviation", "whitened", shares[F.col("_k")].alias("explained"), F.lit(fitted["identity_error"]).alias("identity_error"))


QUERIES = {"op12_whitening": op12_whitening}
SQL: dict[str, str] = {}
