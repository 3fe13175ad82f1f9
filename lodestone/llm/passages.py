"""Substring dedup: repeated passages of 50 words or more, located by Aho-Corasick automata.

A window is 50 consecutive words of one document. A word is removed if a window over it also starts in a
document with a smaller doc_id; windows are judged on the input.

1. Candidates. In each window the 8-word phrase of smallest hash is its anchor, so equal windows have
   equal anchors. Anchors are reduced to smallest and largest doc_id; those of two documents recur.
2. Confirmation. Windows with a recurring anchor are reduced by their hash of 128 bits likewise; those of
   two documents recur, and keep the smallest doc_id.
3. Automata. The anchors of confirmed windows, spelled as three symbols a word, compile into automata; their
   number follows from the number of these phrases, so that each holds a bounded number.
4. Streaming. All documents are read, and every window meets the automaton that would hold its anchor: consecutive
   windows with one anchor send the words that they share, spelled, which hold that anchor. No table of hashes is
   asked; only the automaton tells whether the phrase is a confirmed one, and where it stands. Stretches are dealt in
   ranges of (automaton, hash), so a frequent phrase spreads over many tasks, and the work grows with the
   text, not with the number of automata.
5. Removal. Windows over a located phrase are looked up among the recurring windows, and those whose first
   document is smaller are removed.

All tables are sorted hash arrays (or automata) in shards of bounded size in the shared folder, mapped by
the workers; nothing is collected but counts. Every step reads all rows and whole texts.

Defined cases: null text has no words. A null doc_id neither removes nor is removed from. Rows with one
doc_id don't remove each other's words. Texts under 50 words lose nothing. Extra columns are ignored by
``locate`` and kept by ``cut``, except one with the name of the count that it adds. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from . import hashstore as hs
from .common import materialize, shards_for, text_slices, trim, work_dir
from .words import CHUNK, _powers, mix, split_words

WINDOW = 50
PHRASE = 8
#: phrases of one automaton: about 30 MB in memory, and as much again for a moment while it loads
PER_AUTOMATON = 12_500
#: a word is spelled by 15 bits of its hash, in three symbols of five
_SYMBOLS = np.frombuffer(bytes(range(48, 80)), np.uint8)
_BREAK = ord(" ")
_NULL_ID = -(1 << 63)
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words, by its first position; long texts go by in blocks."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = _powers(CHUNK)
    out = np.empty(n, np.uint64)
    step = CHUNK - length
    for at in range(0, n, step):
        own = words[at : at + step + length - 1]
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * power[: len(own)], out=total[1:])
        m = len(own) - length + 1
        out[at : at + m] = (total[length:] - total[:-length]) * inverse[:m]
    return mix(out + np.uint64(length))


def _block_minima(blocks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running minimum of each row, and the place of its first appearance among ``at``."""
    low = np.minimum.accumulate(blocks, axis=1)
    new = np.ones(blocks.shape, bool)
    new[:, 1:] = low[:, 1:] < low[:, :-1]
    return low, np.maximum.accumulate(np.where(new, np.arange(blocks.shape[1]), 0), axis=1) * (at[0, 1] - at[0, 0] if at.shape[1] > 1 else 0) + at[:, :1]


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of a minimum of each ``width`` consecutive values, from minima of blocks' heads and tails."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    pad = -len(x) % width
    blocks = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    at = np.arange(blocks.size).reshape(blocks.shape)
    head, head_at = (y.ravel()[width - 1 : width - 1 + n] for y in _block_minima(blocks, at))
    tail, tail_at = (y[:, ::-1].ravel()[:n] for y in _block_minima(blocks[:, ::-1], at[:, ::-1]))
    return np.where(tail <= head, tail_at, head_at)


class Slice:
    """Windows of a run of texts: ``at`` holds the valid window starts, ``row`` the row of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        _, _, self.words, self.pointer = split_words(data, offsets)
        size = np.diff(self.pointer)
        self.row = np.repeat(np.arange(len(size)), size)
        starts = np.maximum(0, len(self.words) - WINDOW + 1)
        self.at = np.flatnonzero(self.row[:starts] == self.row[WINDOW - 1 : WINDOW - 1 + starts]) if starts else np.empty(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Key and place of each window's anchor: smallest phrase hashes are small numbers, so they are mixed again."""
        phrases = run_hashes(self.words, PHRASE)
        place = sliding_argmin(phrases, WINDOW - PHRASE + 1)[self.at]
        return mix(phrases[place]), place

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """A key for each row from its doc_id and words."""
        place = np.arange(len(self.words)) - np.repeat(self.pointer[:-1], np.diff(self.pointer))
        mixed = mix(self.words + mix(place.astype(np.uint64)))
        total = np.add.reduceat(np.append(mixed, np.uint64(0)), self.pointer[:-1])
        return mix(mix(ids.astype(np.uint64)) + mix(np.where(np.diff(self.pointer) > 0, total, np.uint64(0))))

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes, 128 bits together, of the windows at ``at``."""
        if not len(at):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        return run_hashes(self.words, WINDOW)[at], run_hashes(mix(self.words ^ _SECOND), WINDOW)[at]

    def codes(self) -> np.ndarray:
        return ((self.words >> np.uint64(40)) & np.uint64(0x7FFF)).astype("u2")


def spell(codes: np.ndarray) -> np.ndarray:
    """(words x 3) symbols of word codes."""
    return _SYMBOLS[np.stack([(codes >> k) & 31 for k in (10, 5, 0)], axis=-1)]


def _least_and_most(keys: np.ndarray, checks: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Smallest and largest id of each (key, check)."""
    if not len(keys):
        return keys, checks, low, high
    order = np.lexsort((checks, keys))
    keys, checks, low, high = keys[order], checks[order], low[order], high[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1]))))
    return keys[first], checks[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


class _Gather:
    """(key, check, smallest doc_id, largest doc_id), combined in the task before anything is sent."""

    def __init__(self, shards: int, limit: int = 1 << 19):
        self.shards, self.limit, self.parts, self.n = shards, limit, [], 0

    def add(self, keys: np.ndarray, checks: np.ndarray, docs: np.ndarray):
        if len(keys):
            part = _least_and_most(keys, checks, docs, docs)
            self.parts.append(part)
            self.n += len(part[0])
        if self.n > self.limit:
            self._combine()
            if self.n > self.limit // 2:
                yield self.flush()

    def _combine(self):
        part = _least_and_most(*(np.concatenate(x) for x in zip(*self.parts)))
        self.parts, self.n = [part], len(part[0])

    def flush(self) -> pa.RecordBatch:
        rows = []
        if self.parts:
            self._combine()
            keys, checks, low, high = self.parts[0]
            one = low == high
            more = ["c", [checks]] if checks.any() else ["", []]
            for kind, own, values in (("one", one, [low]), ("more", ~one, [low, high])):
                rows += hs.blobs(kind + more[0], keys[own], [x[own] for x in (*more[1], *values)], self.shards)
        self.parts, self.n = [], 0
        return hs.rows_to_batch(rows)


def _recurring(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, check, smallest doc_id) of what two documents have."""

    def part(kind, n, data):
        checked = kind.endswith("c")
        arrays = hs.unpack(data, n, ["u8", *["u8"] * checked, "i8", *["i8"] * kind.startswith("more")])
        keys, checks = arrays[0], arrays[1] if checked else np.zeros(n, np.uint64)
        ids = arrays[1 + checked :]
        return keys, checks, ids[0], ids[-1]

    keys, checks, low, high = hs.gather((part(*r) for r in rows), _least_and_most)
    return keys[low < high], checks[low < high], low[low < high]


def _present(stats: list[dict]) -> list[int]:
    return [s["shard"] for s in stats if s.get("n")]


class Finder:
    """Recurring windows of a table and the located phrases of its documents."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        self.shards = shards = shards_for(docs)
        self.uri = uri = work_dir(spark, "passages")
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())

        def anchors(batches):
            got = _Gather(shards)
            for batch in batches:
                ids = np.asarray(batch.column(0))
                for i, j, data, offsets in text_slices(batch.column(1)):
                    s = Slice(data, offsets)
                    key, place = s.anchors()
                    if len(key):
                        new = np.concatenate(([True], place[1:] != place[:-1]))
                        yield from got.add(key[new], np.zeros(int(new.sum()), np.uint64), ids[i:j][s.row[s.at[new]]])
            yield got.flush()

        def keep_anchors(shard, rows):
            keys, _, _ = _recurring(rows)
            hs.save(uri, f"anchor-{shard:05d}", keys)
            return {"n": len(keys)}

        stats = hs.build(docs.mapInArrow(anchors, hs.BLOB), shards, keep_anchors)
        anchor_store = hs.Sorted(uri, "anchor", shards, _present(stats))
        self.anchors = sum(s.get("n", 0) for s in stats)

        def candidates(s: Slice):
            """Starts of windows with a recurring anchor, and their anchors' keys and places."""
            key, place = s.anchors()
            new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(key) else np.empty(0, np.int64)
            distinct, back = np.unique(key[new], return_inverse=True)
            hit = anchor_store.lookup(distinct)[0][back] if len(distinct) else np.empty(0, bool)
            hit = np.repeat(hit, np.diff(np.append(new, len(key))))
            return s.at[hit], key[hit], place[hit]

        def confirm(batches):
            got = _Gather(shards)
            for batch in batches:
                ids = np.asarray(batch.column(0))
                for i, j, data, offsets in text_slices(batch.column(1)):
                    s = Slice(data, offsets)
                    at, _, _ = candidates(s)
                    yield from got.add(*s.windows(at), ids[i:j][s.row[at]])
            yield got.flush()

        def keep_windows(shard, rows):
            keys, checks, first = _recurring(rows)
            for name, x in (("", keys), ("check", checks), ("first", first)):
                hs.save(uri, f"window{name}-{shard:05d}", x)
            return {"n": len(keys)}

        stats = hs.build(docs.mapInArrow(confirm, hs.BLOB), shards, keep_windows)
        self.windows = hs.Sorted(uri, "window", shards, _present(stats), ["check", "first"])
        self.count = sum(s.get("n", 0) for s in stats)
        self.hits = None
        if not self.count:
            return
        # phrases come in fine ranges of their keys, of which each automaton takes as many as its bound allows
        fine = 1 << (6 * self.anchors // PER_AUTOMATON).bit_length()

        def phrases(batches):
            for batch in batches:
                ids = np.asarray(batch.column(0))
                rows = []
                for i, j, data, offsets in text_slices(batch.column(1)):
                    s = Slice(data, offsets)
                    at, key, place = candidates(s)
                    found, first = self._first(*s.windows(at))
                    # of each window, its first document spells the anchor
                    own = np.flatnonzero(found & (first == ids[i:j][s.row[at]]))
                    key, one = np.unique(key[own], return_index=True)
                    if len(key):
                        code = s.codes()[place[own[one]][:, None] + np.arange(PHRASE)]
                        rows += hs.blobs("phrase", key, [np.ascontiguousarray(code).view(f"S{2 * PHRASE}").ravel()], fine)
                yield hs.rows_to_batch(rows)

        found = materialize(docs.mapInArrow(phrases, hs.BLOB), "passages-phrases")
        many = found.agg(F.sum("n")).first()[0] or 0
        self.automata = automata = min(fine, -(-many // PER_AUTOMATON))

        def compile_shard(shard, rows):
            machine, n = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), 0
            for _, size, data in rows:
                code = np.frombuffer(data, "u2", PHRASE * size, 8 * size).reshape(size, PHRASE)
                for word in spell(code).reshape(size, -1):
                    n += machine.add_word(word.tobytes().decode("ascii"))
            machine.make_automaton()
            hs.save(uri, f"automaton-{shard:05d}", np.frombuffer(pickle.dumps(machine), np.uint8))
            return {"n": n}

        dealt = found.withColumn("shard", F.floor(F.col("shard").cast("long") * automata / fine).cast("int"))
        stats = hs.build(dealt, automata, compile_shard)
        self.phrases = sum(s.get("n", 0) for s in stats)
        compiled = _present(stats)

        def stretches(batches):
            """Blobs by automaton: (row key, first word, number of words) of stretches, then their word codes."""
            for batch in batches:
                ids = np.asarray(batch.column(0))
                parts = []
                for i, j, data, offsets in text_slices(batch.column(1)):
                    s = Slice(data, offsets)
                    anchor, place = s.anchors()
                    if not len(anchor):
                        continue
                    # windows over one place share the words from the last one's start to the first one's end
                    edge = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True])))
                    lo, n = s.at[edge[1:] - 1], s.at[edge[:-1]] + WINDOW - s.at[edge[1:] - 1]
                    key = anchor[edge[:-1]]
                    shard = hs.shard_of(key, fine) * automata // fine
                    order = np.argsort(shard, kind="stable")
                    lo, n, shard = lo[order], n[order], shard[order]
                    owner = s.row[lo]
                    words = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    parts.append((shard, s.keys(ids[i:j])[owner], (lo - s.pointer[owner]).astype("u4"), n.astype("u1"), s.codes()[words]))
                rows = []
                cuts = [np.searchsorted(p[0], np.arange(automata + 1)) for p in parts]
                ends = [np.concatenate(([0], np.cumsum(p[3], dtype=np.int64))) for p in parts]
                for k in compiled:
                    spans = [(p, c[k], c[k + 1], e) for p, c, e in zip(parts, cuts, ends) if c[k + 1] > c[k]]
                    if spans:
                        data = [p[f][a:b] for f in (1, 2, 3) for p, a, b, _ in spans] + [p[4][e[a] : e[b]] for p, a, b, e in spans]
                        rows.append((k, "stretch", int(sum(b - a for _, a, b, _ in spans)), hs.pack(data)))
                yield hs.rows_to_batch(rows)

        spelled = docs.mapInArrow(stretches, hs.BLOB)
        spelled = spelled.repartitionByRange(shards, "shard", F.xxhash64("data")).sortWithinPartitions("shard")

        def stream(batches):
            held, machine = None, None
            for batch in batches:
                rows = []
                for k in range(batch.num_rows):
                    shard, n, data = batch.column(0)[k].as_py(), batch.column(2)[k].as_py(), batch.column(3)[k].as_buffer()
                    if shard != held:
                        machine = None  # never two at a time
                        held, machine = shard, pickle.loads(hs.load(uri, f"automaton-{shard:05d}").data)
                    key, first, size = hs.unpack(data, n, ["u8", "u4", "u1"])
                    size = size.astype(np.int64)
                    code = np.frombuffer(data, "u1", offset=13 * n).view("u2")
                    # one break after each stretch keeps matches inside it
                    room = np.full((len(code) + n, 3), _BREAK, np.uint8)
                    room[np.arange(len(code)) + np.repeat(np.arange(n), size)] = spell(code)
                    end = np.fromiter((e for e, _ in machine.iter(room.tobytes().decode("ascii"))), np.int64) + 1
                    place = end[end % 3 == 0] // 3 - PHRASE
                    base = np.cumsum(size + 1) - (size + 1)
                    of = np.searchsorted(base, place, "right") - 1
                    found = np.unique(np.stack([key[of].view(np.int64), first[of] + place - base[of]]), axis=1)
                    order = np.argsort(found[0].view(np.uint64), kind="stable")
                    rows += hs.blobs("hit", found[0].view(np.uint64)[order], [found[1][order]], shards)
                yield hs.rows_to_batch(rows)
                trim()

        def keep_hits(shard, rows):
            key, place = hs.gather((tuple(hs.unpack(data, n, ["u8", "i8"])) for _, n, data in rows), _distinct_pairs)
            hs.save(uri, f"hit-{shard:05d}", key)
            hs.save(uri, f"hitplace-{shard:05d}", place)
            return {"n": len(key)}

        stats = hs.build(spelled.mapInArrow(stream, hs.BLOB), shards, keep_hits)
        self.hits = hs.Sorted(uri, "hit", shards, _present(stats), ["place"])

    def _first(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each window recurs, and its smallest doc_id."""
        order = np.argsort(keys, kind="stable")
        found, first = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        found[order], first[order] = self.windows.find(keys[order], checks[order])
        return found, first

    def covered(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[Slice, np.ndarray]:
        """A slice and the mask of its words to remove; ``ids`` are its rows' doc_ids (_NULL_ID: none)."""
        s = Slice(data, offsets)
        if self.hits is None or not len(s.at):
            return s, np.zeros(len(s.words), bool)
        keys = s.keys(ids)
        distinct, back = np.unique(keys, return_inverse=True)
        owner, (place,) = self.hits.ranges(distinct)
        # rows of equal key (same id and words) share their hits
        of_key = np.argsort(back, kind="stable")
        many = np.bincount(back, minlength=len(distinct))
        start = np.cumsum(many) - many
        row = of_key[np.repeat(start[owner], many[owner]) + _count_up(many[owner])]
        word = s.pointer[row] + np.repeat(place, many[owner])
        usable = ids[row] != _NULL_ID
        row, word = row[usable], word[usable]
        near = np.zeros(len(s.words) + 1, np.int64)
        np.add.at(near, np.maximum(word - (WINDOW - PHRASE), s.pointer[row]), 1)
        np.add.at(near, word + 1, -1)
        at = s.at[np.cumsum(near)[s.at] > 0]
        gone = np.zeros(len(s.words) + 1, np.int64)
        if len(at):
            found, first = self._first(*s.windows(at))
            at = at[found & (first < ids[s.row[at]])]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + WINDOW, -1)
        return s, np.cumsum(gone[:-1]) > 0


def _distinct_pairs(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
    return key[new], place[new]


def _count_up(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def locate(docs: DataFrame, finder: Finder | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; kept words are joined by one space."""
    finder = finder or Finder(docs)

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(_NULL_ID))
            words, removed, digest = [], [], []
            for i, j, data, offsets in text_slices(batch.column(1)):
                s, gone = finder.covered(ids[i:j], data, offsets)
                raw = data.tobytes()
                size = np.diff(s.pointer)
                lost = np.add.reduceat(np.append(gone, False), s.pointer[:-1]) * (size > 0) if len(size) else size
                for k in range(len(size)):
                    own = raw[offsets[k] : offsets[k + 1]].split()
                    if lost[k]:
                        stay = ~gone[s.pointer[k] : s.pointer[k + 1]]
                        own = [own[w] for w in np.flatnonzero(stay).tolist()]
                    digest.append(hashlib.sha256(b" ".join(own)).hexdigest())
                words.append(size)
                removed.append(lost)
            cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), cat(words), cat(removed), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(docs: DataFrame, finder: Finder | None = None, removed: str = "n_removed") -> DataFrame:
    """``docs`` with removed words and the white space after them cut from text; adds the count."""
    finder = finder or Finder(docs)
    docs = docs.drop(removed)
    names = docs.columns

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(names.index("doc_id")).cast(pa.int64()).fill_null(_NULL_ID))
            text = batch.column(names.index("text"))
            nulls = text.is_null().to_pylist() if text.null_count else None
            out, count = [], []
            for i, j, data, offsets in text_slices(text):
                s, gone = finder.covered(ids[i:j], data, offsets)
                start = split_words(data, offsets)[0]
                raw = data.tobytes()
                size = np.diff(s.pointer)
                lost = np.add.reduceat(np.append(gone, False), s.pointer[:-1]) * (size > 0) if len(size) else size
                for k in range(len(size)):
                    lo, hi = int(offsets[k]), int(offsets[k + 1])
                    if lost[k]:
                        a, b = s.pointer[k], s.pointer[k + 1]
                        begin, stay = start[a:b], ~gone[a:b]
                        until = np.append(begin[1:], hi)
                        # runs of kept words keep their own white space
                        edge = np.flatnonzero(np.diff(np.concatenate(([False], stay, [False])).astype(np.int8)))
                        runs = [raw[begin[x] : until[y - 1]] for x, y in zip(edge[::2], edge[1::2])]
                        out.append(b"".join(runs).decode("utf-8"))
                    else:
                        out.append(raw[lo:hi].decode("utf-8"))
                count.append(lost)
            if nulls:
                out = [None if gap else t for t, gap in zip(out, nulls)]
            columns = [pa.array(out, text.type) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(count).astype(np.int64) if count else np.empty(0, np.int64))], [*names, removed])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(removed, LongType()))
