"""Mixing to target weights with soft domain membership.

Domains are the cells (quality, toxic) of the labels table. A softmax regression on each text's statistics and
toxic margin (fitted on at most ``most_toxic`` texts a class) predicts the posterior of each domain for every document. It is
fitted on at most ``most`` different labelled rows, the first by a hash; repeated ones count once. Posteriors are kept
in 256ths, so that equal ones can be summed first; rounding moves an expected share by less than 1/256. Document rates r >= 0 minimise

    1/2 sum_k ((sum_d r_d t_d p_dk - T_k) / S)^2 + anchor/2 sum_d t_d (r_d - 1)^2 / S

by accelerated projected gradient steps, with t tokens, S their sum and T the target totals. Every step is a
Spark job that replays the earlier residuals (one number a domain) on each row and sums expected
totals. As steps depend on a document's posterior alone, documents are first summed by
posterior, which is exact. The targets' total is what the domain of the largest target holds over its share of
the targets, plus ``headroom``: that domain stays whole, however scarce others are. A domain that holds less than
its part of the total is aimed at what it holds, so no domain has to grow, and falls short of its share.

A document of rate r gets floor(r + u) copies, u uniform from a hash of its id and text.

Defined cases: null text has no tokens and the rate of its posterior. Null labels are not read. Domains that
no label names have posterior 0 and no target; without labels all rates are 1. Repeated rows each
count. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from . import toxicity
from .common import hash_sample, materialize, text_slices, trim
from .quality import SIZE, statistics

DOMAINS = ("good_clean", "good_toxic", "poor_clean", "poor_toxic")
TARGETS = {"good_clean": 0.92, "good_toxic": 0.02, "poor_clean": 0.05, "poor_toxic": 0.01}
GRID = 256
#: what the names of columns that are carried along begin with inside
KEPT = "kept_"


def domain_of(quality, toxic):
    return F.when(quality == 1, F.when(toxic == 1, 1).otherwise(0)).otherwise(F.when(toxic == 1, 3).otherwise(2))


def softmax_regression(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 1e-4, steps: int = 400) -> np.ndarray:
    """Weights ((features + 1) x classes) by accelerated gradient descent; classes weighted by their share."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    target = np.eye(classes)[y]
    weight = np.zeros((x.shape[1], classes))
    ahead, rate = weight.copy(), 2.0 / (np.linalg.eigvalsh(x.T @ x / len(x))[-1] + 1e-9)
    for k in range(steps):
        z = x @ ahead
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        after = ahead - rate * (x.T @ (p - target) / len(x) + ridge * ahead)
        ahead = after + k / (k + 3) * (after - weight)
        weight = after
    return weight


class Classifier:
    """Standardised softmax regression; posteriors of ``DOMAINS`` in 256ths."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.seen = np.unique(y)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (0.0, 1.0)
        if len(self.seen) > 1:
            self.weight = softmax_regression((x - self.mean) / self.scale, np.searchsorted(self.seen, y), len(self.seen))

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(DOMAINS)))
        if len(self.seen) > 1:
            z = np.clip((x - self.mean) / self.scale, -50, 50) @ self.weight[:-1] + self.weight[-1]
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            out[:, self.seen] = p / p.sum(1, keepdims=True)
        elif len(self.seen):
            out[:, self.seen] = 1.0
        return np.floor(out * GRID + 0.5)


def uniform():
    """A number in [0, 1) from a row's id and text."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(1 << 40)) / float(1 << 40)


def _features(docs: DataFrame, model: toxicity.Model, keep: list[str] = ()) -> DataFrame:
    kept = [docs.schema[c] for c in keep]
    others = [f.name for f in kept if f.name != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            text = batch.column(0)
            parts = [statistics(data, offsets) for _, _, data, offsets in text_slices(text)]
            x = np.concatenate(parts) if parts else np.empty((0, SIZE))
            z = shared.value.score(text)
            z = np.log(z + 1e-6) - np.log(1 - z + 1e-6)
            full = np.concatenate((x, z[:, None]), axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * (SIZE + 1)), pa.array(full.ravel()))
            words = np.round(np.expm1(x[:, 0])).astype(np.int64)
            own = [text if f.name == "text" else batch.column(3 + others.index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(words), lists, *own], schema.names)

    schema = StructType().add("doc_id", "long").add("u", "double").add("n_tokens", "long").add("x", ArrayType(DoubleType()))
    for f in kept:
        schema = schema.add(KEPT + f.name, f.dataType)
    return docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), uniform().alias("u"), *(F.col(c).alias(KEPT + c) for c in others)).mapInArrow(run, schema)


def fit_rates(groups: DataFrame, targets: dict[str, float], anchor: float = 1e-3, headroom: float = 0.02, steps: int = 80, close: float = 5e-4):
    """Residual history of the projected gradient on (q array<int>, tokens): what ``replay`` needs."""
    totals = groups.agg(*[F.sum(F.col("q")[k] / F.greatest(F.aggregate("q", F.lit(0), lambda a, x: a + x), F.lit(1)) * F.col("tokens")).alias(f"s{k}") for k in range(len(DOMAINS))], F.sum("tokens").alias("s")).first()
    s = np.array([totals[f"s{k}"] or 0.0 for k in range(len(DOMAINS))])
    total = float(totals["s"] or 0)
    want = np.array([targets.get(d, 0.0) if s[k] > 0 else 0.0 for k, d in enumerate(DOMAINS)])
    if not total or not want.sum():
        return [], anchor
    want /= want.sum()
    # domains of the same largest target are all kept: the most any of them needs
    grow = max(s[k] / want[k] for k in range(len(want)) if want[k] == want.max())
    aim = np.minimum(want * grow, s) * (1 + headroom) / total
    history: list[np.ndarray] = []
    for _ in range(steps):

        def expected(batches, history=tuple(history)):
            out = np.zeros(len(DOMAINS))
            for batch in batches:
                p = _unit(_ints(batch.column(0)))
                ahead = replay(p, history, anchor)[1]
                out += (p * (ahead * np.asarray(batch.column(1)))[:, None]).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["k", "v"])

        rows = groups.select("q", "tokens").mapInArrow(expected, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        now = np.zeros(len(DOMAINS))
        for r in rows:
            now[r.k] = r.v
        history.append(now / total - aim)
        if len(history) > 3 and np.abs(history[-1] - history[-2]).max() < close * 1e-2 and np.abs(history[-1]).max() < 1:
            break
    return history, anchor


def replay(p: np.ndarray, history, anchor: float) -> tuple[np.ndarray, np.ndarray]:
    """(rates, extrapolated rates) of posteriors ``p`` after the steps in ``history``."""
    rate = np.ones(len(p))
    ahead = rate.copy()
    step = 1.0 / (1.0 + anchor)
    for k, residual in enumerate(history):
        after = np.maximum(0.0, ahead - step * (p @ residual + anchor * (ahead - 1)))
        ahead = after + k / (k + 3) * (after - rate)
        rate = after
    return rate, ahead


def _ints(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(DOMAINS)).astype(np.float64)


def _unit(q: np.ndarray) -> np.ndarray:
    return q / np.maximum(q.sum(1, keepdims=True), 1)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most: int = 20000, most_toxic: int = 2500) -> DataFrame:
    """(doc_id, u, n_tokens, one posterior for each domain, rate, copies) of every row."""
    _, _, soft, history, anchor = _fit(docs, labels, targets, most, most_toxic)

    def rates(batches):
        for batch in batches:
            p = _unit(_ints(batch.column(3)))
            rate = replay(p, history, anchor)[0]
            copies = np.floor(rate + np.asarray(batch.column(1))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(rate), pa.array(copies)], ["doc_id", "u", "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies"])

    return soft.mapInArrow(rates, "doc_id long, u double, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS) + ", rate double, copies long")


def chosen(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most: int = 20000, most_toxic: int = 2500) -> DataFrame:
    """The rows of ``docs`` with a copy at least, each once. Their columns go along with the features, so no text is shuffled or joined."""
    rows, classifier, _, history, anchor = _fit(docs, labels, targets, most, most_toxic, docs.columns)

    def run(batches):
        for batch in batches:
            q = classifier.posteriors(np.asarray(batch.column(1).flatten()).reshape(-1, SIZE + 1))
            found = np.floor(replay(_unit(q), history, anchor)[0] + np.asarray(batch.column(0))) > 0
            if found.any():
                yield pa.RecordBatch.from_arrays(batch.columns[2:], docs_schema.names).filter(pa.array(found))
        trim()

    docs_schema = docs.schema
    return rows.select("u", "x", *(KEPT + c for c in docs.columns)).mapInArrow(run, docs_schema)


def _fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float], most: int, most_toxic: int, keep: list[str] = ()):
    """(features of every row, with columns ``keep``; classifier; posteriors of every row; residual history; anchor)."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)).select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("y")).distinct()
    model = toxicity.train(docs, labels, F.lit(True), most=most_toxic)
    rows = materialize(_features(docs, model, keep), "mixing-features")
    classifier = _classifier(rows, marks, most)

    def posteriors(batches):
        for batch in batches:
            x = np.asarray(batch.column(3).flatten()).reshape(-1, SIZE + 1)
            q = classifier.posteriors(x).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * q.shape[1]), pa.array(q.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["doc_id", "u", "n_tokens", "q"])

    soft = materialize(rows.select("doc_id", "u", "n_tokens", "x").mapInArrow(posteriors, "doc_id long, u double, n_tokens long, q array<int>"), "mixing-posteriors")
    groups = materialize(soft.groupBy("q").agg(F.sum("n_tokens").cast("double").alias("tokens")), "mixing-groups")
    history, anchor = fit_rates(groups, targets)
    return rows, classifier, soft, history, anchor


def _classifier(rows: DataFrame, marks: DataFrame, most: int) -> Classifier:
    """Fitted on the sample of labelled ``rows``: the driver gets at most ``most`` lists of numbers."""
    known = rows.join(marks, "doc_id").select("y", "x", F.xxhash64("doc_id", "u", "y").alias("h"))
    keys = hash_sample(known.select(F.lit(0).alias("one"), "h"), "one", most).select("h")
    # bounded by most; a row that is repeated has one hash and one x
    sample = known.join(F.broadcast(keys), "h").groupBy("h").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("h").toArrow()
    if not sample.num_rows:
        return Classifier(np.empty((0, SIZE + 1)), np.empty(0, np.int64))
    x = np.asarray(sample["x"].combine_chunks().flatten()).reshape(-1, SIZE + 1)
    return Classifier(x, np.asarray(sample["y"].combine_chunks()).astype(np.int64))
