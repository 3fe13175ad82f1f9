"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of each whole text (rates of byte classes and words, repetition of words and lines, lengths) are
log-transformed. For each class, count, sum and outer products are summed in Spark over all labelled
training rows; the class covariance is shrunk towards the pooled one and that towards its diagonal, and
its Cholesky factor is cached. The raw score is the difference of log densities (Mahalanobis
distances and log determinants); a logistic on its inverse hyperbolic sine, fitted on a histogram of all
training rows, makes it a probability.

Defined cases: null text is empty; the empty text has zero statistics. Labels that are null or of held-out
rows are not read; a row labelled twice with one value counts once. If a class has no row, the
score is the other's share (0.5 without labels). Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_slices
from .toxicity import logistic
from .words import SPACE, mix, split_words

#: byte classes, by what they hold
_CLASS = np.zeros(256, np.int64)
NAMES = ["other", "lower", "upper", "digit", "space", "newline", "stop", "mark", "symbol", "high"]
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[SPACE] = 4
_CLASS[ord("\n")] = 5
_CLASS[[ord(c) for c in ".,;:"]] = 6
_CLASS[[ord(c) for c in "!?"]] = 7
_CLASS[[ord(c) for c in "|#$%&*+<>=@[]^_`{}~/\\"]] = 8
_CLASS[128:] = 9
K = len(NAMES)
SIZE = 16
TINY = 0.002


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x SIZE) transformed statistics."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * K + _CLASS[data], minlength=n * K).reshape(n, K).astype(float)
    start, end, hashes, pointer = split_words(data, offsets, lower=True)
    words = np.diff(pointer)
    owner = np.repeat(np.arange(n), words)
    length = (end - start).astype(float)
    per = lambda x: np.bincount(owner, x, n)
    w = np.maximum(words, 1)
    mean = per(length) / w
    spread = np.sqrt(np.maximum(per(length * length) / w - mean * mean, 0))
    distinct = _distinct(hashes, owner, n)
    same = np.zeros(len(hashes))
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    odd_end = np.isin(_CLASS[data[end - 1]], (7, 8)) if len(end) else np.empty(0)
    capital = np.isin(_CLASS[data[start]], (2,)) if len(start) else np.empty(0)
    lines, unique_lines = _lines(data, offsets)
    b = np.maximum(size, 1)
    rate = lambda x: np.log(x + TINY)
    return np.stack(
        [
            np.log1p(words), np.log1p(mean), np.log1p(spread), rate(kinds[:, 2] / b), rate(kinds[:, 3] / b), rate(kinds[:, 6] / b),
            rate(kinds[:, 7] / b), rate(kinds[:, 8] / b), rate(kinds[:, 9] / b), rate(kinds[:, 0] / b), rate(1 - distinct / w), rate(per(same) / w),
            rate(per(odd_end) / w), rate(per(capital) / w), rate(1 - unique_lines / np.maximum(lines, 1)), np.log1p(words / np.maximum(lines, 1)),
        ],
        axis=1,
    )


def _distinct(hashes, owner, n):
    """Distinct hashes of each owner."""
    _, first = np.unique(mix(hashes + mix(owner.astype(np.uint64))), return_index=True)
    return np.bincount(owner[first], minlength=n).astype(float)


_LINE = np.zeros(256, bool)
_LINE[ord("\n")] = True


def _lines(data, offsets):
    """Numbers of non-empty lines and of distinct ones."""
    n = len(offsets) - 1
    _, _, hashes, pointer = split_words(data, offsets, space=_LINE)
    count = np.diff(pointer)
    return count.astype(float), _distinct(hashes, np.repeat(np.arange(n), count), n)


class Discriminant:
    """Class means, cached Cholesky factors and the logistic of the squashed log-density difference."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.1, ridge: float = 0.05):
        """moments: class -> (n, sum, sum of outer products)."""
        self.total = {y: m[0] for y, m in moments.items() if m[0]}
        self.logistic = (1.0, 0.0)
        self.parts = {}
        if len(self.total) < 2:
            return
        pooled, n = 0.0, 0.0
        scatter = {}
        for y, (c, s, q) in moments.items():
            scatter[y] = q - np.outer(s, s) / c
            pooled, n = pooled + scatter[y], n + c
        pooled = pooled / n
        for y, (c, s, _) in moments.items():
            cov = (1 - shrink) * scatter[y] / c + shrink * pooled
            cov = (1 - ridge) * cov + ridge * np.diag(np.diag(cov)) + 1e-4 * np.eye(len(s))
            low = np.linalg.cholesky(cov)
            self.parts[y] = (s / c, np.linalg.inv(low), np.log(np.diag(low)).sum(), np.log(c / n))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0, priors included, squashed."""
        if len(self.parts) < 2:
            return np.zeros(len(x))
        out = {}
        for y, (mean, inverse, log_det, prior) in self.parts.items():
            z = (x - mean) @ inverse.T
            out[y] = -0.5 * (z * z).sum(1) - log_det + prior
        return np.arcsinh(out[1] - out[0])

    def probability(self, margin: np.ndarray) -> np.ndarray:
        if len(self.parts) < 2:
            n = sum(self.total.values())
            return np.full(len(margin), self.total.get(1, 0) / n if n else 0.5)
        a, b = self.logistic
        return 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and x, the statistics of each whole text."""
    rows = docs.select("text", *keep)

    def run(batches):
        for batch in batches:
            parts = [statistics(data, offsets) for _, _, data, offsets in text_slices(batch.column(0))]
            x = np.concatenate(parts) if parts else np.empty((0, SIZE))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * SIZE), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 1) for k in range(len(keep))), lists], [*keep, "x"])

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    return rows.mapInArrow(run, StructType([rows.schema[c] for c in keep]).add("x", ArrayType(DoubleType())))


def _array(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, SIZE)


def train(known: DataFrame) -> Discriminant:
    """Fit on all rows of (y int, x): class moments, then the logistic on a histogram of margins."""

    def moments(batches):
        total = np.zeros((2, 1 + SIZE + SIZE * SIZE))
        for batch in batches:
            y, x = np.asarray(batch.column(0)), _array(batch.column(1))
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    rows = known.select("y", "x").mapInArrow(moments, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    flat = np.array([r.v for r in rows]).reshape(2, -1) if rows else np.zeros((2, 1 + SIZE + SIZE * SIZE))
    model = Discriminant({k: (flat[k][0], flat[k][1 : 1 + SIZE], flat[k][1 + SIZE :].reshape(SIZE, SIZE)) for k in (0, 1) if flat[k][0]})
    if len(model.parts) < 2:
        return model

    def margins(batches):
        for batch in batches:
            m = np.round(model.margin(_array(batch.column(1))) * 16) / 16
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m)], ["y", "m"])

    bins = known.select("y", "x").mapInArrow(margins, "y int, m double").groupBy("y", "m").count().collect()
    m = np.array([r.m for r in bins])
    w = np.array([float(r["count"]) for r in bins])
    coef = logistic(np.stack([m, np.ones(len(m))], 1), np.array([float(r.y) for r in bins]), w / w.sum())
    model.logistic = (max(float(coef[0]), 1e-3), float(coef[1]))
    return model


def score_texts(docs: DataFrame, labels: DataFrame, learn: str, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """``keep`` columns with score and predicted; learns from labelled rows where boolean column ``learn``."""
    rows = materialize(features(docs, list(dict.fromkeys([*keep, "doc_id", learn]))), "quality-features")
    marks = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y")).distinct()
    model = train(rows.where(learn).select("doc_id", "x").join(marks, "doc_id"))
    names = keep

    def run(batches):
        for batch in batches:
            p = model.probability(model.margin(_array(batch.column(0))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 1) for k in range(len(names))), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    return rows.select("x", *keep).mapInArrow(run, StructType([rows.schema[c] for c in keep]).add("score", DoubleType()).add("predicted", IntegerType()))
