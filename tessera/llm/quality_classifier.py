"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a short vector of transformed document statistics. Per class, a mean and a
covariance come from sums that tasks accumulate and Spark adds up; the covariance is shrunk towards
the pooled one and towards its own diagonal. A score is the difference of the classes' Gaussian log
densities: Mahalanobis distances and log determinants from Cholesky factors that are computed once
and broadcast with the scoring function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: Share of the pooled covariance in each class's, share of the diagonal in the result, least variance.
POOLED, DIAGONAL, FLOOR = 0.1, 0.1, 1e-3
#: Names of the statistics, in order.
FEATURES = (
    "log_words",
    "log_mean_word",
    "log_sd_word",
    "symbols",
    "bars",
    "bangs",
    "capitals",
    "digits",
    "distinct",
    "repeats",
    "top_word",
    "lone_marks",
    "line_words",
    "stops",
)
_SYMBOLS = b"#*$%&<>@^~_=+\\{}[]"
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_ALL_BUT = {k: bytes(set(range(256)) - set(v)) for k, v in (("symbols", _SYMBOLS), ("upper", _UPPER), ("digit", _DIGIT), ("marks", b".!?,;"))}


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of a whole text: logs of sizes, square roots of shares. Null is empty."""
    raw = (text or "").encode("utf-8", "replace")
    parts = raw.split()
    n, size = len(parts), max(len(raw), 1)
    if not n:
        return np.zeros(len(FEATURES))
    lengths = np.fromiter(map(len, parts), np.float64, n)
    of = lambda k: len(raw.translate(None, _ALL_BUT[k])) / size
    counts = Counter(parts)
    same = sum(map(bytes.__eq__, parts, parts[1:])) / n
    lines = raw.count(b"\n") + 1
    return np.array(
        [
            np.log1p(n),
            np.log1p(lengths.mean()),
            np.log1p(lengths.std()),
            np.sqrt(of("symbols")),
            np.sqrt(raw.count(b"|") / size),
            np.sqrt(raw.count(b"!") / size),
            np.sqrt(of("upper")),
            np.sqrt(of("digit")),
            np.log((len(counts) + 1) / (n + 1)) / np.log(n + 2),
            np.sqrt(same),
            np.sqrt(max(counts.values()) / n) - 1 / np.sqrt(n),
            np.sqrt(of("marks")),
            np.log1p(n / lines),
            np.sqrt((lengths <= 3).mean()),
        ]
    )


def vectors(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))


def with_statistics(df: DataFrame, text: str = "text", vector: str = "vector") -> DataFrame:
    """df without its text, with the vector of its statistics in one array column. Null texts are empty ones, which
    have zeros; repeated rows have equal vectors; an empty table gives an empty one; a column named as the vector is replaced."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(list(vectors(texts)))

    return df.withColumn(vector, of(F.col(text))).select(*[c for c in df.columns if c not in (text, vector)], vector)


def class_sums(labelled: DataFrame, label: str, vector: str = "vector") -> DataFrame:
    """Per class: n, sum and sum of products of the vectors, added up map-side first (one row per task and class)."""
    d = len(FEATURES)
    types = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list] = {}
        for b in batches:
            y = np.array(b.column(1).to_pylist(), int)
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in np.unique(y):
                z = x[y == c]
                a = acc.setdefault(int(c), [0, np.zeros(d), np.zeros((d, d))])
                a[0], a[1], a[2] = a[0] + len(z), a[1] + z.sum(0), a[2] + z.T @ z
        cols = list(acc), [a[0] for a in acc.values()], [list(a[1]) for a in acc.values()], [list(a[2].ravel()) for a in acc.values()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["label", "n", "s", "p"])

    parts = labelled.select(vector, F.col(label).cast("int").alias("y")).mapInArrow(sums, "label int, n long, s array<double>, p array<double>")
    total = [F.sum("n").alias("n")] + [F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(k)]).alias(c) for c, k in (("s", d), ("p", d * d))]
    return parts.groupBy("label").agg(*total)


class Model:
    """Means, Cholesky factors of the shrunk covariances, log determinants and priors of classes 0 and 1."""

    def __init__(self, rows, pooled: float = POOLED, diagonal: float = DIAGONAL, floor: float = FLOOR) -> None:
        d = len(FEATURES)
        sums = {r["label"]: (r["n"], np.array(r["s"]), np.array(r["p"]).reshape(d, d)) for r in rows if r["label"] in (0, 1)}
        self.classes = {}
        if set(sums) != {0, 1}:
            return
        scatter = {c: p - np.outer(s, s) / n for c, (n, s, p) in sums.items()}
        total = sum(n for n, _, _ in sums.values())
        shared = sum(scatter.values()) / max(total - 2, 1)
        for c, (n, s, _) in sums.items():
            cov = (1 - pooled) * scatter[c] / max(n - 1, 1) + pooled * shared
            cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + floor * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.classes[c] = (s / n, np.linalg.inv(factor).T, 2 * np.log(np.diag(factor)).sum(), np.log(n / total))

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, from the log-density difference z with the priors: 1/2 + z / (2 (1 + |z|)). It orders
        rows as the posterior does and doesn't run into 0 and 1. Without both classes all are 1/2."""
        if not self.classes:
            return np.full(len(x), 0.5)
        log = {c: prior - 0.5 * (det + (((x - mean) @ inverse) ** 2).sum(1)) for c, (mean, inverse, det, prior) in self.classes.items()}
        z = log[1] - log[0]
        return 0.5 + 0.5 * z / (1 + np.abs(z))


def fit(labelled: DataFrame, label: str = "label", vector: str = "vector", **shrinkage) -> Model:
    """A model from all rows of labelled whose label is 0 or 1. What reaches the driver is one row per class.

    Rows with another label or none are left out. Repeated rows count as often as they come, and contradicting
    labels of one text count for both classes. Without rows of both classes, as of an empty table, all scores are 1/2."""
    rows = class_sums(labelled.where(F.col(label).isin(0, 1)), label, vector).collect()
    return Model(sorted(rows, key=lambda r: r["label"]), **shrinkage)


def score(df: DataFrame, model: Model, vector: str = "vector") -> DataFrame:
    """df without its vector, with score and predicted (1 if score >= 0.5). Null and empty texts are scored
    as texts without words; rows are independent. Columns of df named score or predicted are replaced."""

    @F.pandas_udf("double")
    def scores(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(list(x)).reshape(-1, len(FEATURES))))

    keep = [c for c in df.columns if c not in (vector, "score", "predicted")]
    return df.withColumn("score", scores(F.col(vector))).select(*keep, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text")
    docs = stage(with_statistics(docs), "statistics")  # each text is read once, for fitting and scoring
    known = table(spark, sf_dir, "labels").where(~held_out() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    return score(docs, fit(docs.join(known, "doc_id"))).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
SQL: dict[str, str] = {}
