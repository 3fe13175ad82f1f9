"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, scored from mapped hash arrays.

Tokens: A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+``, then one end token a text. The context of the first
word is a begin mark. The vocabulary is a sorted array of 64-bit word hashes with counts, in range
shards; a word's id is its rank. Bigrams are pairs of ids, in sorted arrays of mixed pair keys.

    p(w|c) = (n(c,w) - D(n(c,w))) / n(c.) + g(c) q(w)
    q(w)   = (m(w) - d(m(w))) / M + h / (V + 1)

n counts bigrams, m(w) the distinct words before w, M all distinct bigrams; D and d are the modified
discounts of each order from its counts of counts, g and h the mass they free. Words never seen share the
base's V + 1-th place, so probabilities over V words and one unknown sum to 1.

``order`` is 2 (above) or 3. With 3, trigrams (a, c, w) have the counts n and the first formula over contexts (a, c);
pairs have m(c, w), the distinct words before them, in the place of n, with discounts of their own. The first two words of
a text have begin marks before them. All counts cover all training rows; no n-gram is pruned. Model size grows
with the input, in shards of the shared folder. Trigrams and their contexts are told apart by 64-bit hashes of ids.

Defined cases: null and empty texts have the one end token. Without any training token, every base score
is log10(1/1) a token and the model's likewise. Null doc_ids learn (their remainder is unknown, not 2).
Repeated rows count each time. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashstore as hs
from .common import shards_for, text_slices, work_dir
from .words import mix, split_words

END = int(mix(np.array([0x656E64], np.uint64))[0])
_ID_LIMIT = 1 << 32
#: what pair shards send of each id: distinct words before it; its pairs seen once, twice, more often; the counts of the last
_FIELDS = ("m", "c1", "c2", "c3", "t")


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(hash of each token, pointer): the words of each text, then its end token."""
    _, _, words, pointer = split_words(data, offsets, lower=True)
    n = len(pointer) - 1
    ends = pointer + np.arange(n + 1)
    out = np.empty(len(words) + n, np.uint64)
    place = np.ones(len(out), bool)
    place[ends[1:] - 1] = False
    out[place] = words
    out[~place] = np.uint64(END)
    return out, ends


class _Counts:
    """key -> count, combined in the task; sent when large."""

    def __init__(self, shards: int, limit: int = 1 << 21):
        self.shards, self.limit, self.parts, self.n = shards, limit, [], 0

    def add(self, keys: np.ndarray):
        keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts.astype(np.int64)))
        self.n += len(keys)
        if self.n > self.limit:
            self._combine()
            if self.n > self.limit // 2:
                yield self.flush()

    def _combine(self):
        if self.parts:
            part = hs.sum_by_key(*(np.concatenate(x) for x in zip(*self.parts)))
            self.parts, self.n = [part], len(part[0])

    def flush(self) -> pa.RecordBatch:
        rows = []
        if self.parts:
            self._combine()
            rows = _counted("", *self.parts[0], self.shards)
        self.parts, self.n = [], 0
        return hs.rows_to_batch(rows)


def _counted(kind: str, keys: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple]:
    """Blobs of sorted keys and counts; a count of one isn't written."""
    one = counts == 1
    rows = [*hs.blobs(f"{kind}one", keys[one], [], shards)]
    for k, c in hs.thirty_two(keys[~one], counts[~one]):
        rows += hs.blobs(f"{kind}more", k, [c], shards)
    return rows


def _uncounted(kind: str, n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if kind.endswith("one"):
        return hs.unpack(data, n, ["u8"])[0], np.ones(n, np.int64)
    k, c = hs.unpack(data, n, ["u8", "u4"])
    return k, c.astype(np.int64)


def _total(rows) -> tuple[np.ndarray, np.ndarray]:
    return hs.gather((_uncounted(*r) for r in rows), hs.sum_by_key)


def _save_counts(uri: str, name: str, shard: int, keys: np.ndarray, counts: np.ndarray) -> dict:
    """Keys, counts in a byte, and those of 255 or more once more in full."""
    hs.save(uri, f"{name}-{shard:05d}", keys)
    hs.save(uri, f"{name}count-{shard:05d}", np.minimum(counts, 255).astype(np.uint8))
    large = counts >= 255
    hs.save(uri, f"{name}large-{shard:05d}", keys[large])
    hs.save(uri, f"{name}largecount-{shard:05d}", counts[large])
    return {"n": len(keys), "of": np.bincount(np.minimum(counts, 5), minlength=6).tolist()}


def _free(D: list[float], c1, c2, c3, t) -> tuple[np.ndarray, np.ndarray]:
    """(mass that the discounts free, all counts) of contexts with c1, c2, c3 n-grams seen once, twice, more often; t: the last's counts."""
    every = c1 + 2 * c2 + t
    return np.where(every > 0, (D[0] * c1 + D[1] * c2 + D[2] * c3) / np.maximum(every, 1), 1.0), every


def triple_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a trigram from the key of its first two ids and its last id."""
    return mix(context + word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Triples:
    """Trigrams (ids of 32 bits) and their counts, combined in the task by hash; sent when large."""

    def __init__(self, shards: int, limit: int = 1 << 20):
        self.shards, self.limit, self.parts, self.n = shards, limit, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        context = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        self.parts.append(_same_triples(context, w.astype("u4"), np.ones(len(w), np.int64)))
        self.n += len(self.parts[-1][0])
        if self.n > self.limit:
            self.parts = [_same_triples(*(np.concatenate(x) for x in zip(*self.parts)))]
            self.n = len(self.parts[0][0])
            if self.n > self.limit // 2:
                yield self.flush()

    def flush(self) -> pa.RecordBatch:
        rows = []
        if self.parts:
            context, word, count = _same_triples(*(np.concatenate(x) for x in zip(*self.parts)))
            shard = hs.shard_of(triple_key(mix(context), word), self.shards)
            for kind, own in (("one", count == 1), ("more", count > 1)):
                c, w, n, s = context[own], word[own], count[own], shard[own]
                cuts = np.searchsorted(s, np.arange(self.shards + 1))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[k], cuts[k + 1])
                    rows.append((k, kind, int(cuts[k + 1] - cuts[k]), hs.pack([c[part], w[part], *([n[part].astype("i8")] if kind == "more" else [])])))
        self.parts, self.n = [], 0
        return hs.rows_to_batch(rows)


def _same_triples(context: np.ndarray, word: np.ndarray, count: np.ndarray):
    """Equal trigrams summed, in order of their key."""
    if not len(word):
        return context, word, count
    key = triple_key(mix(context), word)
    order = np.argsort(key, kind="stable")
    key, context, word, count = key[order], context[order], word[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return context[first], word[first], np.add.reduceat(count, first)


#: Pair keys: the two ids of 32 bits, passed through an invertible mix so that shards are even.
def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix((context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64))


def _unshift(x: np.ndarray, by: int) -> np.ndarray:
    y, k = x.copy(), by
    while k < 64:
        y = x ^ (y >> np.uint64(by))
        k += by
    return y


def pair_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of ``pair_key``."""
    x = _unshift(keys, 31)
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = _unshift(x, 27)
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x = _unshift(x, 30)
    return (x >> np.uint64(32)).astype(np.int64), (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney D1, D2, D3+ from the numbers of n-grams seen 1 to 4 times, within [0, k]."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return [0.5, 0.5, 0.5] if not n1 else [0.75, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]


class Model:
    """A fitted model: stores in the shared folder and a few totals; picklable and small."""

    def __init__(self, docs: DataFrame, learn: Column, order: int = 2):
        """Count ``docs.text`` where ``learn``."""
        if order not in (2, 3):
            raise ValueError("order is 2 or 3")
        spark = docs.sparkSession
        self.shards = shards = shards_for(docs)
        self.uri = uri = work_dir(spark, "kneser")
        self.order = order
        train = docs.where(learn).select("text")

        def words(batches):
            got = _Counts(shards)
            for batch in batches:
                for _, _, data, offsets in text_slices(batch.column(0)):
                    yield from got.add(tokens(data, offsets)[0])
            yield got.flush()

        def keep_words(shard, rows):
            keys, counts = _total(rows)
            hs.save(uri, f"word-{shard:05d}", keys)
            hs.save(uri, f"wordcount-{shard:05d}", counts)
            return {"n": len(keys), "tokens": int(counts.sum())}

        stats = hs.build(train.mapInArrow(words, hs.BLOB), shards, keep_words)
        size = np.array([s.get("n", 0) for s in stats], np.int64)
        self.base = np.concatenate(([0], np.cumsum(size)))  # id of each shard's first word
        self.V, self.N = int(self.base[-1]), sum(s.get("tokens", 0) for s in stats)
        if self.V + 1 >= _ID_LIMIT:
            raise ValueError("vocabularies of 2^32 words or more need wider pair keys")
        self.present = [s["shard"] for s in stats if s.get("n")]
        vocabulary = self._words()

        def pairs(batches):
            got = _Counts(shards)
            for batch in batches:
                for _, _, data, offsets in text_slices(batch.column(0)):
                    ids, before = self._ids(vocabulary, data, offsets)[:2]
                    yield from got.add(pair_key(before, ids))
            yield got.flush()

        parts = train.mapInArrow(pairs, hs.BLOB) if order == 2 else self._trigrams(train, vocabulary)
        stats = hs.build(parts, shards, self._keep_pairs())
        self.M = sum(s.get("n", 0) for s in stats)
        self.pair_shards = [s["shard"] for s in stats if s.get("n")]
        self.context_shards = [s["shard"] for s in stats if s.get("contexts")]
        self.D = discounts(np.sum([s.get("of", [0] * 6) for s in stats], axis=0)[1:5].tolist())
        self._finish_words(spark, shards)

    def _trigrams(self, train: DataFrame, vocabulary) -> DataFrame:
        """Writes the trigrams; gives the blobs of their pairs: distinct words before each, and counts of each as context."""
        shards, uri = self.shards, self.uri

        def triples(batches):
            got = _Triples(shards)
            for batch in batches:
                for _, _, data, offsets in text_slices(batch.column(0)):
                    ids, before, _, ends = self._ids(vocabulary, data, offsets)
                    yield from got.add(self._second(before, ends), before, ids)
            yield got.flush()

        def part(kind, n, data):
            if kind == "one":
                return (*hs.unpack(data, n, ["u8", "u4"]), np.ones(n, np.int64))
            return tuple(hs.unpack(data, n, ["u8", "u4", "i8"]))

        def keep(shard, rows):
            context, word, count = hs.gather((part(*r) for r in rows), _same_triples)
            stats = _save_counts(uri, "triple", shard, triple_key(mix(context), word), count)

            def out():
                keys, counts = np.unique(pair_key(context & np.uint64(0xFFFFFFFF), word), return_counts=True)
                yield from _counted("m", keys, counts.astype(np.int64), shards)
                for kind, own in (("c1", count == 1), ("c2", count == 2), ("c3", count >= 3)):
                    keys, counts = np.unique(mix(context[own]), return_counts=True)
                    yield from _counted(kind, keys, counts.astype(np.int64), shards)
                own = count >= 3
                yield from _counted("t", *hs.sum_by_key(mix(context[own]), count[own]), shards)

            return stats, out()

        stats, parts = hs.build_on(train.mapInArrow(triples, hs.BLOB), shards, keep, "kneser-pairs")
        self.triple_shards = [s["shard"] for s in stats if s.get("n")]
        self.D3 = discounts(np.sum([s.get("of", [0] * 6) for s in stats], axis=0)[1:5].tolist())
        return parts

    def _keep_pairs(self):
        uri, order, D3 = self.uri, self.order, getattr(self, "D3", None)

        def keep(shard, rows):
            if order == 2:
                return _save_counts(uri, "pair", shard, *_total(rows))
            names = ("m", "c1", "c2", "c3", "t")

            def part(kind, n, data):
                keys, counts = _uncounted(kind, n, data)
                field = names.index(kind.removesuffix("one").removesuffix("more"))
                return keys, np.full(n, field, np.uint8), counts

            def combine(keys, field, counts):
                order = np.lexsort((field, keys))
                keys, field, counts = keys[order], field[order], counts[order]
                first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (field[1:] != field[:-1])))) if len(keys) else np.empty(0, np.int64)
                return keys[first], field[first], np.add.reduceat(counts, first) if len(first) else counts

            keys, field, counts = hs.gather((part(*r) for r in rows), combine)
            pair = field == 0
            stats = _save_counts(uri, "pair", shard, keys[pair], counts[pair])
            contexts, at = np.unique(keys[~pair], return_inverse=True)
            c1, c2, c3, t = (np.bincount(at[own], counts[~pair][own], len(contexts)) for own in (field[~pair] == k for k in (1, 2, 3, 4)))
            free, every = _free(D3, c1, c2, c3, t)
            hs.save(uri, f"context-{shard:05d}", contexts)
            hs.save(uri, f"contextfree-{shard:05d}", free)
            hs.save(uri, f"contextevery-{shard:05d}", every)
            return stats | {"contexts": len(contexts)}

        return keep

    def _second(self, before: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ids two places before each token; begin marks stand before a text."""
        out = np.empty_like(before)
        out[1:] = before[:-1]
        out[ends[:-1]] = self.V
        return out

    def _words(self):
        return hs.Sorted(self.uri, "word", self.shards, self.present, ["count"])

    def _ids(self, vocabulary, data, offsets):
        """Ids of all tokens (V: unknown), ids before them (V: begin, or unknown as V + 1), counts, ends."""
        token, ends = tokens(data, offsets)
        distinct, back = np.unique(token, return_inverse=True)
        found, place, (count,) = vocabulary.lookup(distinct)
        own = np.where(found, place + self.base[hs.shard_of(distinct, self.shards)], self.V)
        ids = own[back]
        before = np.empty_like(ids)
        before[1:] = np.where(ids[:-1] == self.V, self.V + 1, ids[:-1])
        before[ends[:-1]] = self.V
        return ids, before, np.where(found, count, 0)[back], ends

    def _finish_words(self, spark, shards: int) -> None:
        """For each id: distinct words before it, and of it as context the pairs seen 1, 2, 3+ times and all counts.

        Each pair shard sends partial sums by id range, so frequent contexts spread over all shards.
        """
        uri, V = self.uri, self.V
        width = -(-(V + 1) // shards)

        def partial(batches):
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    keys, counts = hs.load(uri, f"pair-{shard:05d}"), hs.load(uri, f"paircount-{shard:05d}").astype(np.int64)
                    counts[counts == 255] = hs.load(uri, f"pairlargecount-{shard:05d}")
                    context, word = pair_of(np.asarray(keys))
                    fields = []
                    for ids, amount in (
                        (word, None),
                        (context[counts == 1], None),
                        (context[counts == 2], None),
                        (context[counts >= 3], None),
                        (context[counts >= 3], counts[counts >= 3]),
                    ):
                        ids, amount = np.unique(ids, return_counts=True) if amount is None else hs.sum_by_key(ids, amount)
                        fields.append((ids, amount, np.searchsorted(ids, np.arange(shards + 1) * width)))
                    rows = []
                    for s in range(shards):
                        # one blob for each id range: for each field its length, ids and amounts
                        size = [int(cuts[s + 1] - cuts[s]) for _, _, cuts in fields]
                        if any(size):
                            data = [np.array(size, "u4")]
                            for ids, amount, cuts in fields:
                                lo, hi = cuts[s], cuts[s + 1]
                                data += [(ids[lo:hi] - s * width).astype("u4"), amount[lo:hi].astype("i8")]
                            rows.append((s, "ids", sum(size), hs.pack(data)))
                    yield hs.rows_to_batch(rows)

        def keep(shard, rows):
            n = min(width, V + 1 - shard * width)
            total = np.zeros((len(_FIELDS), n), np.int64)
            for _, _, data in rows:
                size = np.frombuffer(data, "u4", len(_FIELDS)).tolist()
                at = 4 * len(size)
                for field, k in enumerate(size):
                    ids, amount = hs.unpack(data[at : at + 12 * k], k, ["u4", "i8"])
                    at += 12 * k
                    total[field][ids] += amount
            m, c1, c2, c3, t = total
            free, every = _free(self.D, c1, c2, c3, t)
            hs.save(uri, f"before-{shard:05d}", m)
            hs.save(uri, f"free-{shard:05d}", free)
            hs.save(uri, f"every-{shard:05d}", every)
            return {"n": n, "of": np.bincount(np.minimum(m, 5), minlength=6).tolist(), "many": int((m >= 3).sum())}

        present = spark.createDataFrame([(s,) for s in self.pair_shards], "shard int").repartitionById(shards, F.col("shard"))
        stats = hs.build(present.mapInArrow(partial, hs.BLOB), shards, keep)
        of = np.sum([s.get("of", [0] * 6) for s in stats], axis=0)
        self.width = width
        self.id_shards = [s["shard"] for s in stats if s.get("n")]
        self.d = discounts(of[1:5].tolist())
        self.h = (self.d[0] * of[1] + self.d[1] * of[2] + self.d[2] * sum(s.get("many", 0) for s in stats)) / max(self.M, 1)

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Opens the arrays (memory-mapped) and scores texts."""

    def __init__(self, model: Model):
        self.m = model
        self.words = model._words()
        self.pairs = hs.Sorted(model.uri, "pair", model.shards, model.pair_shards, ["count"])
        self.large = hs.Sorted(model.uri, "pairlarge", model.shards, model.pair_shards, ["count"])
        if model.order == 3:
            self.triples = hs.Sorted(model.uri, "triple", model.shards, model.triple_shards, ["count"])
            self.many = hs.Sorted(model.uri, "triplelarge", model.shards, model.triple_shards, ["count"])
            self.contexts = hs.Sorted(model.uri, "context", model.shards, model.context_shards, ["free", "every"])
        self.by_id: dict[tuple[str, int], np.ndarray] = {}

    def _gather(self, name: str, ids: np.ndarray, missing: float) -> np.ndarray:
        """Values of sorted distinct ids; ids past the vocabulary get ``missing``."""
        out = np.full(len(ids), missing, np.float64)
        cuts = np.searchsorted(ids, np.arange(self.m.shards + 1) * self.m.width)
        for s in self.m.id_shards:
            lo, hi = cuts[s], cuts[s + 1]
            if hi > lo:
                if (name, s) not in self.by_id:
                    self.by_id[name, s] = hs.load(self.m.uri, f"{name}-{s:05d}")
                own = self.by_id[name, s]
                at = ids[lo:hi] - s * self.m.width
                inside = at < len(own)
                out[lo:hi][inside] = own[at[inside]]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray):
        """(tokens, known tokens, base log10, model log10) of each text."""
        m = self.m
        ids, before, count, ends = m._ids(self.words, data, offsets)
        n = np.diff(ends)
        base = np.log10((count + 1.0) / (m.N + m.V + 1.0))
        if not m.N:
            return n, np.zeros_like(n), np.zeros(len(n)), np.zeros(len(n))
        distinct, back = np.unique(ids, return_inverse=True)
        seen = self._gather("before", distinct, 0.0)
        seen[distinct == m.V] = 0.0  # the begin mark's row: no word
        lower = (seen - _discount(seen, m.d)) / m.M + m.h / (m.V + 1.0)
        contexts, of = np.unique(before, return_inverse=True)
        free, every = self._gather("free", contexts, 1.0), self._gather("every", contexts, 0.0)
        keys, pair = np.unique(pair_key(before, ids), return_inverse=True)
        times = _times(self.pairs, self.large, keys)
        top = (times - _discount(times, m.D))[pair]
        p = top / np.maximum(every[of], 1.0) + free[of] * lower[back]
        if m.order == 3:
            keys, at = np.unique(pair_key(m._second(before, ends), before), return_inverse=True)
            found, _, (free, every) = self.contexts.lookup(keys)
            free, every = np.where(found, free, 1.0), np.where(found, every, 0.0)
            triples, triple = np.unique(triple_key(keys[at], ids), return_inverse=True)
            times = _times(self.triples, self.many, triples)
            p = (times - _discount(times, m.D3))[triple] / np.maximum(every[at], 1.0) + free[at] * p
        sums = lambda x: np.add.reduceat(x, ends[:-1])  # noqa: E731  every text has a token
        return n, sums((count > 0).astype(np.int64)), sums(base), sums(np.log10(p))


def _times(store: hs.Sorted, large: hs.Sorted, keys: np.ndarray) -> np.ndarray:
    """Counts of sorted keys; what fills a byte is looked up once more."""
    _, _, (times,) = store.lookup(keys)
    times = times.astype(np.float64)
    if len(big := np.flatnonzero(times == 255)):
        times[big] = large.lookup(keys[big])[2][0]
    return times


def _discount(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3).astype(np.int64)]


def score_texts(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of docs with n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    rows = docs.select("text", *keep)
    total = model.N

    def run(batches):
        scorer = model.scorer()
        for batch in batches:
            parts = [scorer.score(data, offsets) for _, _, data, offsets in text_slices(batch.column(0))]
            n, known, base, score = (np.concatenate(x) for x in zip(*parts)) if parts else ([], [], [], [])
            columns = [pa.array(np.asarray(n, np.int64)), pa.array(np.asarray(known, np.int64)), pa.array(np.full(len(n), total, np.int64)), pa.array(np.asarray(base, np.float64)), pa.array(np.asarray(score, np.float64)), pa.array(10 ** (-np.asarray(score, np.float64) / np.maximum(np.asarray(n, np.float64), 1)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 1) for k in range(len(keep))), *columns], [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    from pyspark.sql.types import DoubleType, LongType, StructType

    schema = StructType([rows.schema[c] for c in keep])
    for name, kind in (("n_tokens", LongType()), ("n_known", LongType()), ("train_tokens", LongType()), ("base_score", DoubleType()), ("score", DoubleType()), ("perplexity", DoubleType())):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)
