"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word (lower-cased letters and digits) is the bag of its own hash and of its byte 3- to 6-grams, hashed to
2^17 rows of an embedding table; so unseen misspellings share vectors with known words. A window of five
words is the average of its words' vectors, and a linear softmax scores it. A document is as toxic as its
worst window: training alternates between picking each document's highest windows and fitting
embeddings and softmax together on them (negatives: the highest and random windows of clean
documents). A two-parameter logistic on the highest margin and the number of words, fitted on the
training documents with all labels' class shares, turns it into a probability.

As softmax of two classes is linear in the averaged vectors, scoring folds table and weights into one
number for each row; whole texts are scored, window by window.

Training takes at most ``most`` different labelled texts of each class, chosen by hash, each of at most ``longest``
characters and together of at most ``most_chars`` (documented bounds; longer texts are scored, whole, but not learned from).

Defined cases: null text is empty; a text without words has the score of a document without margin. Labels
that are null, or of held-out rows, are not read. Without both classes the score is the share of toxic
labels (0 without labels). Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, materialize, text_slices
from .words import mix, split_words

BITS = 17
ROWS = 1 << BITS
DIM = 8
WINDOW = 5
GRAMS = (3, 4, 5, 6)
#: white space for this splitter: all of ASCII but letters and digits
BREAKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(row of each subword, pointer): rows of word i at pointer[i]:pointer[i+1]; the first is the word's."""
    size = end - start
    # each word between marks: < w >
    room = size + 2
    first = np.cumsum(room) - room
    text = np.empty(int(room.sum()), np.uint64)
    text[first] = 60
    text[first + room - 1] = 62
    inner = np.repeat(start - first - 1, size) + (np.arange(int(size.sum())) + np.repeat(first + 1 - (np.cumsum(size) - size), size))
    place = np.ones(len(text), bool)
    place[first] = place[first + room - 1] = False
    text[place] = data[inner]
    left = np.repeat(first + room, room) - np.arange(len(text))  # bytes to the word's end
    owners, rows, code = [np.arange(len(size))], [], np.zeros(len(text), np.uint64)
    of = np.repeat(np.arange(len(size)), room)
    n = len(text)
    for k in range(1, max(GRAMS) + 1):
        code[: n - k + 1] = code[: n - k + 1] * np.uint64(0x100000001B3) + text[k - 1 :] + np.uint64(1)
        if k in GRAMS:
            ok = np.flatnonzero(left >= k)
            owners.append(of[ok])
            rows.append((mix(code[ok] + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64))
    return owners, rows


def word_rows(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray):
    """(owner, row) of all subwords, unordered, and the number of subwords of each word."""
    owners, rows = subwords(data, start, end)
    own = (mix(hashes + np.uint64(77)) >> np.uint64(64 - BITS)).astype(np.int64)
    owner, row = np.concatenate(owners), np.concatenate([own, *rows])
    return owner, row, np.bincount(owner, minlength=len(start))


def split(texts: pa.Array):
    """(row span, data, offsets, words) of each slice of a text column."""
    lowered = pc.utf8_lower(texts.fill_null(""))
    for i, j, data, offsets in text_slices(lowered):
        yield i, j, data, split_words(data, offsets, space=BREAKS)


class Model:
    """``row_margin``: toxic minus clean logit of each table row; ``bias``; logistic (a, b, c)."""

    def __init__(self, row_margin, bias, logistic):
        self.row_margin, self.bias, self.logistic = row_margin, bias, logistic

    def word_margins(self, data, start, end, hashes):
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if not len(distinct):
            return np.empty(0)
        owner, row, count = word_rows(data, start[at], end[at], distinct)
        return (np.bincount(owner, self.row_margin[row], len(distinct)) / count)[back]

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, j, data, (start, end, hashes, pointer) in split(texts):
            out[i:j] = self.probability(highest(self.word_margins(data, start, end, hashes), pointer) + self.bias, np.diff(pointer))
        return out

    def probability(self, margin, n):
        a, b, c = self.logistic
        z = a * np.where(n > 0, margin, self.bias) + b + c * np.log1p(n)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def window_means(margin: np.ndarray, pointer: np.ndarray):
    """Mean of each window of up to WINDOW words that starts at a word and stays in its text."""
    total = np.concatenate(([0.0], np.cumsum(margin)))
    n = len(margin)
    stop = np.minimum(np.arange(n) + WINDOW, np.repeat(pointer[1:], np.diff(pointer)))
    # the last windows of a text move back to keep their width
    begin = np.maximum(stop - WINDOW, np.repeat(pointer[:-1], np.diff(pointer)))
    return (total[stop] - total[begin]) / (stop - begin), begin, stop


def highest(margin: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    size = np.diff(pointer)
    if not len(margin):
        return np.zeros(len(size))
    means, _, _ = window_means(margin, pointer)
    out = np.maximum.reduceat(np.append(means, -np.inf), pointer[:-1])
    return np.where(size > 0, out, 0.0)


#: words that training looks at together: the driver's memory is small
_TOKENS = 1 << 18


def _runs(pointer: np.ndarray, most: int = _TOKENS):
    """(first, end) of runs of documents with at most ``most`` words, or one document."""
    at, n = 0, len(pointer) - 1
    while at < n:
        stop = min(n, max(at + 1, int(np.searchsorted(pointer, pointer[at] + most, "right")) - 1))
        yield at, stop
        at = stop


def fit(texts: list[str], toxic: np.ndarray, share: float, seed: int = 7, rounds: int = 6, steps: int = 25) -> Model:
    """Train on whole texts with 0/1 labels; ``share`` of toxic rows among all labels sets the logistic."""
    rng = np.random.default_rng(seed)
    parts, sizes, known = [], [], np.empty(0, np.uint64)
    words = []  # subwords of the words in order of appearance
    for first in range(0, len(texts), 1024):
        for _, _, piece, (s, e, h, p) in split(pa.array(texts[first : first + 1024], pa.large_string())):
            distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
            new = np.flatnonzero(~np.isin(distinct, known))
            if len(new):
                owner, row, count = word_rows(piece, s[where[new]], e[where[new]], distinct[new])
                words.append((distinct[new], row[np.argsort(owner, kind="stable")].astype(np.int32), count))
                known = np.union1d(known, distinct[new])
            sizes.append(np.diff(p))
            parts.append((distinct, back.astype(np.int32)))
    if not len(known):
        return constant(share)
    # ids of words are their places in the sorted list of all
    token = np.concatenate([np.searchsorted(known, d).astype(np.int32)[b] for d, b in parts])
    del parts
    pointer = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    found, count = np.concatenate([w[0] for w in words]), np.concatenate([w[2] for w in words])
    begin = np.cumsum(count) - count
    order = np.argsort(found)
    row = np.concatenate([w[1] for w in words])
    del words
    count, begin = count[order], begin[order]
    row = row[np.repeat(begin, count) + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))]
    edge = np.concatenate(([0], np.cumsum(count)))
    del found, begin, order, known
    table = rng.normal(0, 0.1, (ROWS, DIM)).astype(np.float32)
    weight = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    square = [np.full(x.shape, 1e-6, np.float32) for x in (table, weight, bias)]
    # the first picks come from document frequencies: words of toxic documents that clean ones lack
    n_pos, n_neg = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    seen = np.zeros((2, len(count)))
    for a, b in _runs(pointer):
        own = token[pointer[a] : pointer[b]].astype(np.int64) * (b - a) + np.repeat(np.arange(b - a), np.diff(pointer[a : b + 1]))
        pair = np.unique(own)
        for y in (0, 1):
            seen[y] += np.bincount((pair // (b - a))[toxic[a:b][pair % (b - a)] == y], minlength=len(count))
    in_neg, in_pos = (np.bincount(row, np.repeat(x, count), ROWS) for x in seen)
    row_margin = np.log((in_pos + 0.5) / n_pos) - np.log((in_neg + 0.5) / n_neg)
    for turn in range(rounds):
        margin = np.add.reduceat(row_margin[row], edge[:-1]) / count
        picked = []
        for a, b in _runs(pointer):
            # each document's highest windows, and for clean ones random windows too
            p = pointer[a : b + 1] - pointer[a]
            means, begin, stop = window_means(margin[token[pointer[a] : pointer[b]]], p)
            doc = np.repeat(np.arange(b - a), np.diff(p))
            by = np.lexsort((-means, doc))
            place = np.arange(len(by)) - p[doc[by]]
            clean = toxic[a:b][doc] == 0
            top = by[(place < 3) & clean[by] | (place < 1)]
            extra = rng.choice(len(means), min(len(means), 3 * len(top))) if len(means) else top
            chosen = np.unique(np.concatenate((top, extra[clean[extra]])))
            picked.append((begin[chosen] + pointer[a], stop[chosen] - begin[chosen], toxic[a:b][doc[chosen]]))
        start, width, y = (np.concatenate(x) for x in zip(*picked))
        y = y.astype(np.int64)
        used, local = np.unique(token[np.repeat(start, width) + (np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width))], return_inverse=True)
        bag = np.repeat(np.arange(len(start)), width)
        w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        size = count[used]
        cut = np.cumsum(size) - size
        sub, of = row[np.repeat(edge[used], size) + (np.arange(size.sum()) - np.repeat(cut, size))], np.repeat(np.arange(len(used)), size)
        # gradients of table rows: subwords in order of rows
        by_row = np.argsort(sub, kind="stable")
        held, first = np.unique(sub[by_row], return_index=True)
        of = of[by_row]
        by_word = np.argsort(local, kind="stable")
        bag, word = bag[by_word], np.flatnonzero(np.diff(local[by_word], prepend=-1))
        for _ in range(steps):
            vectors = np.add.reduceat(table[sub], cut) / size[:, None].astype(np.float32)
            x = np.add.reduceat(vectors[local], np.cumsum(width) - width) / width[:, None]
            z = x @ weight + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            g = p
            g[np.arange(len(y)), y] -= 1
            g *= w[:, None]
            g_x = (g @ weight.T) / width[:, None]
            g_word = np.add.reduceat(g_x[bag], word) / size[:, None]
            g_table = np.zeros((ROWS, DIM), np.float32)
            g_table[held] = np.add.reduceat(g_word.astype(np.float32)[of], first)
            for value, grad, sq, rate in ((table, g_table + 1e-7 * table, square[0], 0.1), (weight, x.T @ g, square[1], 0.1), (bias, g.sum(0), square[2], 0.1)):
                sq += (grad * grad).astype(np.float32)
                value -= (rate * grad / np.sqrt(sq)).astype(np.float32)
        row_margin = (table @ (weight[:, 1] - weight[:, 0])).astype(np.float64)
    shift = float(bias[1] - bias[0])
    margin = np.add.reduceat(row_margin[row], edge[:-1]) / count
    top = np.concatenate([highest(margin[token[pointer[a] : pointer[b]]], pointer[a : b + 1] - pointer[a]) for a, b in _runs(pointer)]) + shift
    size = np.diff(pointer)
    top = np.where(size > 0, top, shift)
    w = np.where(toxic == 1, share / n_pos, (1 - share) / n_neg)
    design = np.stack([top, np.ones(len(top)), np.log1p(size)], 1)
    coef = logistic(design, toxic.astype(float), w / w.sum())
    return Model(row_margin, shift, tuple(coef))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    coef = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * coef
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(coef))
        step = np.linalg.solve(hess, grad)
        coef -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return coef


def constant(share: float) -> Model:
    """A model that gives every text the same score."""
    return Model(np.zeros(ROWS), 0.0, (0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), 0.0))


def train(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", most: int = 2500, longest: int = 1 << 18, most_chars: int = 12_000_000) -> Model:
    """Fit on labelled texts where ``learn``: of each class at most ``most`` different ones of at most ``longest`` characters.

    The first by a hash of the text are taken, up to ``most_chars`` characters a class.
    """
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    texts = docs.where(learn).select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), "text")
    marked = materialize(texts.drop("text").join(known, "doc_id").select("y", "h", "n"), "toxicity-labelled")
    sizes = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    keys = materialize(hash_sample(marked.where(F.col("n") <= longest), "y", most), "toxicity-sample")
    sized = keys.join(marked.select("y", "h", "n").distinct(), ["y", "h"]).collect()
    wanted, left = [], {0: most_chars, 1: most_chars}
    for r in sorted(sized, key=lambda r: (r.h % (1 << 40), r.h)):
        if left[r.y] >= r.n:
            left[r.y] -= r.n
            wanted.append((r.y, r.h))
    if len({y for y, _ in wanted}) < 2:
        return constant(share)
    # at most 2 * most keys travel, and each text once, however often it stands in the table
    chosen = docs.sparkSession.createDataFrame(sorted({(h,) for _, h in wanted}), "h long")
    found = texts.where(F.col("n") <= longest).join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text"))
    text_of = {r.h: r.text or "" for r in found.collect()}
    return fit([text_of[h] for _, h in wanted], np.array([y for y, _ in wanted]), share)


def score_texts(docs: DataFrame, model: Model, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """``keep`` columns with score and predicted of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("text", *keep)

    def run(batches):
        for batch in batches:
            p = shared.value.score(batch.column(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 1) for k in range(len(keep))), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    return rows.mapInArrow(run, StructType([rows.schema[c] for c in keep]).add("score", DoubleType()).add("predicted", IntegerType()))
