"""Near-duplicate clustering of questions: greedy, in sequence order, within blocks of equal first characters.

A question joins the earliest representative of its block that contains it, is contained in it, or whose
matching-blocks ratio with it reaches the threshold; else it becomes a representative. The result depends on
order, so it is not the same as connected components.

1. Distinct normalised forms keep their first sequence number.
2. A block's forms are dealt to tiles of two chunks each, so a large block spreads over many tasks and no task
   holds more than two chunks. Within a tile, products of matrices that count common characters and common pairs of
   characters by place bound the ratio of all pairs at once; each pair is looked at in one direction. For the pairs
   left, a bit-parallel longest common subsequence over all of a form's, joined to one long integer, bounds the ratio
   from above, and few pairs need the ratio itself. Lengths too far apart for the ratio are skipped; containment is
   found by hashes of first characters. Only matching pairs leave the tile.
3. Each block's matches are walked in order. A block with more than ``WALK`` matches is decided in rounds of joins
   instead, so that no task holds it: a form without an undecided earlier match represents, and what
   matches a representative joins.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keep import keep, written

CHUNK = 4096
#: most first characters by which contained forms are found; forms of a slab of products; pairs that need no products
HEAD, SLAB, FEW = 32, 256, 1 << 12
#: (characters of a gram, cuts into sections, columns) of the bounds by products
BOUNDS = ((1, (), 510), (2, (-20, 0, 20), 1022))
WALK = 1 << 20
#: tasks a core, at least, that tiles are dealt to
TASKS = 8
ONES, MIX = np.array([bin(k).count("1") for k in range(256)], np.uint8), np.uint64(0x9E3779B97F4A7C15)


def sequence(rank: Column, ordinal: Column, line: Column) -> Column:
    """Key of a candidate whose string order is that of (rank of its library, post ordinal, line)."""
    wide = lambda c, n: F.lpad(F.hex(c.cast("long")), n, "0")
    return F.concat(wide(rank, 2), wide(ordinal, 16), wide(line, 8))


def ratio(new: str, old: str) -> float:
    """Matching-blocks ratio; not symmetric, the new form comes first."""
    return SequenceMatcher(None, new, old).ratio()


class _Chunk:
    """Forms side by side in one integer, each in whole words with a zero bit behind it, for the bit-parallel
    subsequence length."""

    def __init__(self, forms: list[str]):
        self.forms = forms
        self.size = np.array([len(f) for f in forms], np.int64)
        self.words = int(self.size.max()) // 64 + 1
        cells = np.zeros((len(forms), self.words * 64), np.uint32)
        inside = np.arange(cells.shape[1]) < self.size[:, None]
        cells[inside] = _codes(forms)
        self.room = self._packed(inside)
        chars = np.unique(cells[inside])
        self.rows = {chr(c): k for k, c in enumerate(chars)}
        self.masks = np.stack([self._packed(inside & (cells == c)) for c in chars])

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def common(self, text: str) -> np.ndarray:
        """Length of the longest common subsequence of ``text`` with each form."""
        return self.among(text, slice(None))

    def among(self, text: str, which) -> np.ndarray:
        """The same for the forms at ``which`` alone."""
        chars = [c for c in set(text) if c in self.rows]
        own = self.masks[[self.rows[c] for c in chars]] if isinstance(which, slice) else self.masks[np.array([self.rows[c] for c in chars], int)[:, None], which]
        masks = {c: int.from_bytes(m.tobytes(), "little") for c, m in zip(chars, own)}
        v = room = int.from_bytes(self.room[which].tobytes(), "little")
        for c in text:
            m = masks.get(c)
            if m is not None:
                u = v & m
                v = ((v + u) | (v - u)) & room
        size = self.size[which]
        left = np.frombuffer(v.to_bytes(len(size) * self.words * 8, "little"), np.uint8).reshape(len(size), -1)
        return size - ONES[left].sum(axis=1, dtype=np.int64)


def _codes(forms: list[str]) -> np.ndarray:
    return np.frombuffer("".join(forms).encode("utf-32-le"), np.uint32)


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, and which occurrence of its key each is."""
    key = np.sort(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key, np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))


def _features(left: list[str], right: list[str], least: float, q: int, cuts: tuple[int, ...], most: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of numbers a form, such that no pair of a ratio of ``least`` or more has a negative product of rows.

    The characters in matching blocks, ``least`` / 2 of both lengths at least, leave so few others that the blocks
    are few, and so hold ``slope`` of both lengths less q - 1 grams of q characters at least. Counted from the middles,
    a gram and its match are apart by (1 - least) / least of the right form's length at most. So a gram of the left
    counts in its own section between ``cuts``, one of the right in every section that it may be matched from. Grams
    that occur again are other grams. Rare grams share columns, which can only make a product larger.
    """
    forms, n = left + right, len(left)
    size = np.array([len(f) for f in forms], np.int64)
    chars, code = np.unique(_codes(forms), return_inverse=True)
    owner = np.repeat(np.arange(len(forms)), size)
    middle = 2 * (np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)) - np.repeat(size, size)
    gram = code.astype(np.int64)
    for k in range(1, q):
        gram = gram[:-1] * len(chars) + code[k:]
    whole = owner[: len(gram)] == owner[q - 1 :]
    gram, owner, middle = gram[whole], owner[: len(whole)][whole], middle[: len(whole)][whole]
    gram = np.unique(gram, return_inverse=True)[1]
    if not len(gram):
        return np.zeros((n, 1), np.float32), np.zeros((len(right), 1), np.float32)
    kinds, sections, edge = int(gram.max()) + 1, len(cuts) + 1, 2 * np.array(cuts)
    far = np.where(owner < n, 0.0, 2 * size[owner] * (1 - least) / least + 1e-6) if cuts else 0
    first, last = np.searchsorted(edge, middle - far, "right"), np.searchsorted(edge, middle + far, "right")
    times = last - first + 1
    section = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
    key, nth = _numbered((np.repeat(owner, times) * sections + section) * kinds + np.repeat(gram, times))
    owner, key = np.divmod(key, sections * kinds)
    own, column = np.unique(key * (int(nth.max()) + 1) + nth, return_inverse=True)
    # grams of one side alone have no column; the most frequent have one to themselves
    uses = np.bincount(column[owner < n], minlength=len(own)) * np.bincount(column[owner >= n], minlength=len(own))
    rank = np.empty(len(own), np.int64)
    rank[np.argsort(-uses, kind="stable")] = np.arange(len(own))
    width = max(1, min(most, np.count_nonzero(uses)))
    place = np.where(rank < width, rank, width - 1 - rank % max(1, width // 2))
    used = uses[column] > 0
    rows = np.bincount((owner * width + place[column])[used], minlength=len(forms) * width).reshape(len(forms), width)
    slope = least * (2 * q - 1) / 2 - (q - 1)
    short, one = -(slope * size - (q - 1) / 2), np.ones(len(forms))
    return np.column_stack([rows[:n], short[:n], one[:n]]).astype(np.float32), np.column_stack([rows[n:], one[n:], short[n:]]).astype(np.float32)


def _near(left: list[str], right: list[str], least: float, same: bool):
    """(i, js): forms of the right whose ratio with the left form can reach ``least``. Both are in order of length;
    where they are the ``same``, later ones only."""
    size = [np.array([len(f) for f in forms], np.int64) for forms in (left, right)]
    words = size[1] // 64
    starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]).tolist()
    chunks = [(a, b, _Chunk(right[a:b])) for a, b in zip(starts, [*starts[1:], len(right)])]
    sides = []
    if len(left) * len(right) > FEW:
        sides = [_features(left, right, least, q, cuts, most) for q, cuts, most in BOUNDS if least * (2 * q - 1) / 2 > q - 1]
    wide = (2 - least) / least if least > 0 else np.inf
    for at in range(0, len(left), SLAB):
        own = size[0][at : at + SLAB]
        a, b = np.searchsorted(size[1], own[0] / wide - 1e-6), np.searchsorted(size[1], own[-1] * wide + 1e-6, "right")
        a = max(a, at) if same else a
        if a >= b:
            continue
        fits = 2.0 * np.minimum(own[:, None], size[1][None, a:b]) >= least * (own[:, None] + size[1][None, a:b])
        for x, y in sides:
            fits &= x[at : at + SLAB] @ y[a:b].T >= -1e-3
        if same:
            fits &= np.arange(a, b) > np.arange(at, at + len(own))[:, None]
        for i in np.flatnonzero(fits.any(axis=1)).tolist():
            js, text = a + np.flatnonzero(fits[i]), left[at + i]
            for first, last, chunk in chunks:
                which = js[np.searchsorted(js, first) : np.searchsorted(js, last)] - first
                if len(which):
                    found = which[2.0 * chunk.among(text, which) / (len(text) + chunk.size[which]) >= least]
                    if len(found):
                        yield at + i, (found + first).tolist()


def _inside(inner: list[str], outer: list[str]) -> set[tuple[int, int]]:
    """(i, j) of forms that the other side's form j contains, found by the hash of their first 1, 2, 4, .. characters."""
    size = [np.array([len(f) for f in forms], np.int64) for forms in (inner, outer)]
    start = [np.cumsum(s) - s for s in size]
    hashes = [_codes(forms).astype(np.uint64) * MIX for forms in (inner, outer)]
    owner = np.repeat(np.arange(len(outer)), size[1])
    left = np.repeat(size[1] + start[1], size[1]) - np.arange(len(owner))
    found, h = set(), 1
    while h <= HEAD:
        own = np.flatnonzero((size[0] >= h) & ((size[0] < 2 * h) | (h == HEAD)))
        if len(own):
            heads = hashes[0][start[0][own]]
            order = np.argsort(heads, kind="stable")
            own, heads = own[order], heads[order]
            seen = np.zeros(1 << 16, bool)
            seen[heads >> np.uint64(48)] = True
            at = np.flatnonzero(seen[hashes[1] >> np.uint64(48)] & (left[: len(hashes[1])] >= h))
            low, high = (np.searchsorted(heads, hashes[1][at], side) for side in ("left", "right"))
            for p, a, b in zip(*(x[high > low].tolist() for x in (at, low, high))):
                j = int(owner[p])
                text, k = outer[j], p - int(start[1][j])
                found.update((int(i), j) for i in own[a:b] if text.startswith(inner[i], k))
        for side in (0, 1):
            x = hashes[side]
            hashes[side] = (x[:-h] * MIX ^ x[:-h] >> np.uint64(29)) + x[h:] * (MIX + np.uint64(2 * h)) if len(x) > h else x[:0]
        h *= 2
        if not len(hashes[0]) or not len(hashes[1]):
            break
    return found


def _matches(new: list[str], new_seq: list, old: list[str], old_seq: list, threshold: float):
    """(new, old) index pairs of one tile that match, whichever is the earlier. A list held against itself gives each pair once."""
    same = new is old
    by = [sorted(range(len(forms)), key=lambda k: len(forms[k])) for forms in (new, old)]
    inside = _inside(new, old) | (set() if same else {(i, j) for j, i in _inside(old, new)})
    if same:
        inside = {(i, j) for i, j in inside if i != j}
    yield from sorted(inside)
    if threshold > 1:
        return
    left = [new[k] for k in by[0]]
    for i, js in _near(left, left if same else [old[k] for k in by[1]], threshold - 1e-9, same):
        i = by[0][i]
        for j in (by[1][j] for j in js):
            if (i, j) not in inside and not (same and (j, i) in inside):
                pair = (new[i], old[j]) if old_seq[j] < new_seq[i] else (old[j], new[i])
                if ratio(*pair) >= threshold:
                    yield i, j


def edges(forms: DataFrame, threshold: float = 0.84, chunk: int = CHUNK) -> DataFrame:
    """(block, new, old): sequence keys of matching forms. ``forms`` has (block, norm, seq)."""
    # a form alone in its block has no pair
    sizes = forms.groupBy("block").agg(F.count("*").alias("_n"), F.ceil(F.count("*") / float(chunk)).cast("int").alias("chunks")).where(F.col("_n") > 1)
    dealt = forms.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("norm"), F.col("chunks")).cast("int"))
    # chunk i meets every chunk j >= i once: it goes to the tiles (i, j) and (j, i)
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "block", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "norm", "seq"
    )

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        block, a, b = pdf["block"].iloc[0], pdf["a"].iloc[0], pdf["b"].iloc[0]
        one, two = ((own["norm"].tolist(), own["seq"].tolist()) for own in (pdf[pdf["part"] == p] for p in (a, b)))
        if a == b:
            two = one
        new_seq, old_seq = [], []
        if one[0] and two[0]:
            for i, j in _matches(*one, *two, threshold):
                old, new = sorted((one[1][i], two[1][j]))
                new_seq.append(new)
                old_seq.append(old)
        return pd.DataFrame({"block": [block] * len(new_seq), "new": new_seq, "old": old_seq}, dtype="object")

    # a tile is few bytes and much work: its number of tasks must not follow the bytes
    spark = forms.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism)
    return tiles.repartition(tasks, "block", "a", "b").groupBy("block", "a", "b").applyInPandas(tile, "block string, new string, old string")


def _walked(matches: DataFrame) -> DataFrame:
    """(seq, rep) of blocks of bounded size, one after the other."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        joined: dict[str, str] = {}
        for new, olds in pdf.groupby("new", sort=True)["old"]:
            reps = [o for o in olds if o not in joined]
            if reps:
                joined[new] = min(reps)
        return pd.DataFrame({"seq": list(joined.keys()), "rep": list(joined.values())}, dtype="object")

    return matches.groupBy("block").applyInPandas(walk, "seq string, rep string")


def _in_rounds(matches: DataFrame) -> DataFrame:
    """(seq, rep) by rounds: each settles all forms whose earlier matches are settled."""
    left, joined = written(matches.select("new", "old"), "cluster-left"), None
    while left.head(1):
        first = left.select("old").distinct().join(left.select(F.col("new").alias("old")).distinct(), "old", "left_anti")
        now = written(left.join(first, "old", "left_semi").select("new").distinct(), "cluster-joined")
        joined = now if joined is None else joined.unionByName(now)
        left = written(left.join(now, "new", "left_anti").join(now.withColumnRenamed("new", "old"), "old", "left_anti"), "cluster-left")
    reps = matches.select("new", "old") if joined is None else matches.select("new", "old").join(joined.withColumnRenamed("new", "old"), "old", "left_anti")
    return reps.groupBy(F.col("new").alias("seq")).agg(F.min("old").alias("rep"))


def representatives(matches: DataFrame, walk: int = WALK) -> DataFrame:
    """(seq, rep) of every form that joins an earlier one: the earliest representative that it matches."""
    sizes = matches.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > walk)
    large = [r.block for r in sizes.select("block").collect()]
    if not large:
        return _walked(matches)
    heavy = F.col("block").isin(large)
    return _walked(matches.where(~heavy)).unionByName(_in_rounds(matches.where(heavy)))


def cluster_forms(rows: DataFrame, threshold: float | None = 0.84, block: int = 2, chunk: int = CHUNK, walk: int = WALK) -> DataFrame:
    """(norm, cluster) of each distinct normalised form; ``rows`` has (norm, seq).

    ``cluster`` is the representative's sequence number. Without a threshold only equal forms share one.
    """
    forms = rows.groupBy("norm").agg(F.min("seq").alias("seq")).withColumn("block", F.substring("norm", 1, block))
    if threshold is None:
        return forms.select("norm", F.col("seq").alias("cluster"))
    # block sizes, tiles and the last join all read the forms
    forms = keep(forms)
    joined = representatives(keep(edges(forms, threshold, chunk)), walk)
    return forms.select("norm", "seq").join(joined, "seq", "left").select("norm", F.coalesce("rep", "seq").alias("cluster"))
