"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

The model is byte-fallback BPE with an identity normaliser and a dummy prefix; its ids are those of the
sentencepiece library. A token sequence is the BPE encoding of a text exactly if each two neighbours are the
BPE encoding of their joint string. So encoding is a best path in a graph of tokens, where a
neighbour pair weighs 0 if it holds and minus infinity if not, and one path is finite.

Texts over ``giant`` characters are cut into chunks at fixed positions, whatever stands there. A cut's states
are the tokens that may cover the character before it. Each chunk, alone, yields its max-plus
transfer matrix from the states of its left cut to those of its right one; matrices combine
associatively along a document, a backward pass fixes each cut's token, and every chunk is then
backtraced on its own. Inside a chunk, no token crosses from other text into a space mark, so there the graph has a
single state, and a chunk's matrix is the product of those of its segments: the part of one at the left cut, the whole
space-led ones (one state to one state), the part of one at the right cut. All of them are searched here, once: the ids of
the whole ones go along with the matrix, and only the two parts wait for their states;
the path of a whole segment is kept for its next occurrence. The library encodes texts that aren't giant, and no part
of those that are.

Defined cases: null text has null ids; the empty text has none. U+2581 in a text counts as a space, as in
the library, and is the only character that decoding does not give back. Repeated rows, extra columns and null
ids are kept. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import materialize, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
GIANT = 1 << 15
CHUNK = 1 << 13
_BREAK = re.compile(rf"(?<=[^{SPACE}])(?={SPACE})")
_SEGMENT = re.compile(rf"{SPACE}+[^{SPACE}]*")
_MINUS = -np.inf


@lru_cache(maxsize=1)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Pieces:
    """The model's pieces and scores, BPE on short strings, and the test of neighbouring tokens."""

    def __init__(self, path: str):
        self.lib = _library(path)
        n = self.lib.get_piece_size()
        self.id = {self.lib.id_to_piece(i): i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i))}
        self.score = {p: self.lib.get_score(i) for p, i in self.id.items()}
        self.byte = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.id))
        self.starts = {piece[:n] for piece in self.id for n in range(2, len(piece) + 1)}
        self._holds: dict[tuple[str, str], bool] = {}
        self._segments: dict[str, bytes | None] = {}

    def bpe(self, text: str) -> list[str]:
        """Merge the best-scored pair, leftmost first, until none is a piece."""
        parts = list(text)
        while True:
            best, at = _MINUS, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and s > best:
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def holds(self, a: str, b: str) -> bool:
        """Whether tokens a, b may be neighbours."""
        if b[0] == SPACE and a[-1] != SPACE:
            return True
        key = (a, b)
        if key not in self._holds:
            if len(self._holds) > 1 << 17:
                self._holds.clear()
            self._holds[key] = self.bpe(a + b) == [a, b]
        return self._holds[key]

    def tokens_from(self, text: str, at: int) -> list[str]:
        """Tokens that may start at ``at``: pieces that are their own encoding, and the lone character."""
        out = [text[at]]
        for n in range(2, min(self.longest, len(text) - at) + 1):
            t = text[at : at + n]
            if t not in self.starts:
                break
            if t in self.id and self._whole(t):
                out.append(t)
        return out

    def _whole(self, t: str) -> bool:
        key = (t, "")
        if key not in self._holds:
            self._holds[key] = self.bpe(t) == [t]
        return self._holds[key]

    def ids(self, tokens: list[str]) -> list[int]:
        out = []
        for t in tokens:
            if t in self.id:
                out.append(self.id[t])
            else:
                out += [self.byte[b] for b in t.encode("utf-8")]
        return out

    def states(self, text: str, cut: int) -> list[tuple[int, str]]:
        """(start, token) of all tokens that may cover the character before ``cut``."""
        return [(s, t) for s in range(max(0, cut - self.longest), cut) for t in self.tokens_from(text, s) if s + len(t) >= cut]

    def paths(self, text: str, entry: list[tuple[int, str]], stop: int):
        """Tokens reachable from ``entry``: end -> {(start, token): (set of entries, predecessors)}.

        Walks positions until all open ends are at or past ``stop``.
        """
        ends: dict[int, dict[tuple[int, str], tuple[set[int], list]]] = {}
        for k, (s, t) in enumerate(entry):
            ends.setdefault(s + len(t), {}).setdefault((s, t), (set(), []))[0].add(k)
        at = min(ends)
        while at < stop:
            here = ends.get(at)
            if here:
                for t in self.tokens_from(text, at):
                    of, before = set(), []
                    for (s, prior), (entries, _) in here.items():
                        if self.holds(prior, t):
                            of |= entries
                            before.append((s, prior))
                    if of:
                        slot = ends.setdefault(at + len(t), {}).setdefault((at, t), (set(), []))
                        slot[0].update(of)
                        slot[1].extend(before)
            at += 1
        return ends

    def backtrace(self, ends, final: tuple[int, str]) -> list[str]:
        """Tokens from just after the entry to ``final``, along the finite path."""
        out, node = [], final
        while True:
            _, before = ends[node[0] + len(node[1])][node]
            if not before:
                return out[::-1]
            out.append(node[1])
            node = before[0]

    def from_state(self, text: str, at: int, stop: int):
        """Paths from a single state at ``at``, as if the text began there."""
        ends = {at: {(at, ""): ({0}, [])}}
        for k in range(at, stop):
            if k in ends:
                for t in self.tokens_from(text, k):
                    before = [node for node in ends[k] if not node[1] or self.holds(node[1], t)]
                    if before:
                        ends.setdefault(k + len(t), {}).setdefault((k, t), ({0}, []))[1].extend(before)
        return ends

    def segments(self, texts: list[str]) -> bytes | None:
        """Ids (32 bits, little-endian) of the finite paths through whole segments, in order; None if one has none."""
        known = self._segments
        try:
            return b"".join([known[t] if t in known else self.segment(t) for t in texts])
        except TypeError:
            return None

    def segment(self, text: str) -> bytes | None:
        """Ids of the finite path through a whole segment; None if there is none."""
        ends = self.from_state(text, 0, len(text))
        final = next(iter(ends.get(len(text), ())), None)
        out = None if final is None else np.array(self.ids(self.backtrace(ends, final)), "<i4").tobytes()
        if len(text) <= 48:
            if len(self._segments) > 1 << 17:
                self._segments.clear()
            self._segments[text] = out
        return out


@lru_cache(maxsize=1)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


class Chunk:
    """Characters lo to hi of a marked text of n characters; ``text`` starts at ``base`` and has context."""

    def __init__(self, pieces: Pieces, text: str, base: int, lo: int, hi: int, n: int):
        self.p, self.text, self.base, self.n = pieces, text, base, n
        self.lo, self.hi = lo - base, hi - base
        self.last = hi == n
        # local positions; the text's start is a state of its own, an empty token before everything
        self.entry = [(0, "")] if lo == 0 else pieces.states(text, self.lo)
        self.exit = pieces.states(text, self.hi) if hi < n else [(s, t) for s, t in pieces.states(text, self.hi) if s + len(t) == self.hi]
        # breaks usable inside: past every entry token, before every exit token
        first = max(s + len(t) for s, t in self.entry)
        last = min((s for s, _ in self.exit), default=self.hi)
        start, end = first if first else 1, max(last, 1)
        found = _BREAK.search(text, start, end)
        self.breaks = (found.start(), _last_break(text, start, end)) if found and found.start() <= last else None
        self._inner: bytes | None = None

    def _paths(self, entry, stop):
        return self.p.from_state(self.text, 0, stop) if entry == [(0, "")] else self.p.paths(self.text, entry, stop)

    def inner(self) -> bytes | None:
        """Ids of the whole segments between the outer breaks; None if one has no path."""
        if self._inner is None:
            self._inner = self.p.segments(_SEGMENT.findall(self.text, *self.breaks))
        return self._inner

    def edges(self) -> tuple[str, int, int, bytes]:
        """(text before the first and from the last break, its cut, the last break, ids between); all the text and -1 where there are none."""
        if not self.breaks:
            return self.text, -1, -1, b""
        a, b = self.breaks
        return self.text[:a] + self.text[b:], a, b, self.inner() or b""

    def matrix(self) -> np.ndarray:
        """Max-plus transfer matrix: 0 where a finite path leads from an entry to an exit state."""
        out = np.full((len(self.entry), len(self.exit)), _MINUS)
        if self.breaks:
            a, b = self.breaks
            left = self._paths(self.entry, a)
            reach = set().union(*(of for of, _ in left.get(a, {}).values()))
            if (self.last and b >= self.hi) or self.inner() is None:
                return out
            right = self.p.from_state(self.text, b, self.hi)
            for j, (s, t) in enumerate(self.exit):
                if (s, t) in right.get(s + len(t), {}):
                    out[sorted(reach), j] = 0
            return out
        ends = self._paths(self.entry, self.hi)
        for j, (s, t) in enumerate(self.exit):
            hit = ends.get(s + len(t), {}).get((s, t))
            if hit:
                out[sorted(hit[0]), j] = 0
        return out

    def ids(self, entry: int, exit_: int) -> np.ndarray:
        """Ids of the tokens after entry state ``entry`` up to and with exit state ``exit_``."""
        if self.breaks:
            return edge_ids(self.p, *self.edges(), self.lo, self.hi, self.base, self.n, entry, exit_)
        return np.array(self.p.ids(self.p.backtrace(self._paths([self.entry[entry]], self.hi), self.exit[exit_])), "<i4")


def edge_ids(p: Pieces, text: str, cut: int, last: int, inner: bytes, lo: int, hi: int, base: int, n: int, entry: int, exit_: int) -> np.ndarray:
    """``Chunk.ids`` from a chunk's ``edges``; ``lo`` and ``hi`` count from ``base``."""
    left, right, hi = text[:cut], text[cut:], hi - last
    start = [(0, "")] if lo + base == 0 else [p.states(left, lo)[entry]]
    ends = p.from_state(left, 0, cut) if start == [(0, "")] else p.paths(left, start, cut)
    exits = p.states(right, hi)
    if hi + last + base == n:
        exits = [(s, t) for s, t in exits if s + len(t) == hi]
    before = p.ids(p.backtrace(ends, next(iter(ends[cut]))))
    after = p.ids(p.backtrace(p.from_state(right, 0, hi), exits[exit_]))
    return np.concatenate((np.array(before, "<i4"), np.frombuffer(inner, "<i4"), np.array(after, "<i4")))


def _last_break(text: str, start: int, end: int) -> int:
    """The last match of ``_BREAK`` in text[start:end], which has one."""
    at = end
    while True:
        at = text.rindex(SPACE, start, at)
        if text[at - 1] != SPACE:
            return at


def mark(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def chunk_rows(text: str, size: int = CHUNK, context: int = 40):
    """(number, base, lo, hi, n, characters with context) of a giant text's chunks."""
    marked = mark(text)
    n = len(marked)
    cuts = [*range(0, max(1, n - size // 2), size), n]
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        base = max(0, lo - context)
        yield k, base, lo, hi, n, marked[base : hi + context]


def combine(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(entry, exit) state of each chunk on the best path.

    Prefix products in the max-plus semiring; vectors times matrices suffice, as the start is one state.
    """
    value = [np.zeros(1)]
    for m in matrices:
        value.append((value[-1][:, None] + m).max(0))
    exit_ = int(value[-1].argmax())
    out = []
    for v, m in zip(value[-2::-1], matrices[::-1]):
        entry = int((v + m[:, exit_]).argmax())
        out.append((entry, exit_))
        exit_ = entry
    return out[::-1]


def encode_giant(text: str, pieces: Pieces, size: int = CHUNK) -> list[int]:
    """The scan on one machine, as Spark runs it in steps."""
    if not text:
        return []
    chunks = [Chunk(pieces, t, base, lo, hi, n) for _, base, lo, hi, n, t in chunk_rows(text, size)]
    out: list[int] = []
    for c, (a, b) in zip(chunks, combine([c.matrix() for c in chunks])):
        out += c.ids(a, b).tolist()
    return out


_CHUNK_SCHEMA = "key long, k int, base long, lo long, hi long, n long, piece string"
#: a chunk's matrix, and what ``edge_ids`` needs once its states are known
_EDGE_SCHEMA = "key long, k int, base long, lo long, hi long, n long, width int, finite binary, piece string, cut long, last long, inner binary"
_EDGES = pa.schema([*((c, pa.int32() if c in ("k", "width") else pa.int64()) for c in ("key", "k", "base", "lo", "hi", "n", "width")), ("finite", pa.binary()), ("piece", pa.string()), ("cut", pa.int64()), ("last", pa.int64()), ("inner", pa.binary())])


def _giant_ids(giants: DataFrame, path: str, size: int) -> DataFrame:
    """(key, token_ids, n_chunks) of (key, text)."""

    def cut(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(key, k, base, lo, hi, n, t) for k, base, lo, hi, n, t in chunk_rows(text.as_py(), size)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["key", "k", "base", "lo", "hi", "n", "piece"])

    chunks = materialize(giants.mapInArrow(cut, _CHUNK_SCHEMA).repartition("key", "k"), "pieces-chunks")

    def transfer(batches):
        pieces = _pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(at, 64).to_pylist():
                    c = Chunk(pieces, r["piece"], r["base"], r["lo"], r["hi"], r["n"])
                    m = c.matrix()
                    rows.append((r["key"], r["k"], r["base"], r["lo"], r["hi"], r["n"], m.shape[1], np.isfinite(m).tobytes(), *c.edges()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _EDGES)], _EDGES)
            trim()

    edges = materialize(chunks.mapInArrow(transfer, _EDGE_SCHEMA), "pieces-edges")
    matrices = edges.select("key", "k", "width", "finite")

    def scan(pdf):
        import pandas as pd

        pdf = pdf.sort_values("k")
        ms = [np.where(np.frombuffer(f, bool).reshape(-1, w), 0.0, _MINUS) for f, w in zip(pdf["finite"], pdf["width"])]
        ends = combine(ms)
        return pd.DataFrame({"key": pdf["key"].values, "k": pdf["k"].values, "a": [x for x, _ in ends], "b": [y for _, y in ends]})

    # one document's matrices are some thousand bits a chunk
    states = materialize(matrices.groupBy("key").applyInPandas(scan, "key long, k int, a int, b int"), "pieces-states")

    def trace(batches):
        pieces = _pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, ids = batch.slice(at, 64), []
                for r in part.to_pylist():
                    lo, hi = r["lo"] - r["base"], r["hi"] - r["base"]
                    if r["cut"] < 0:
                        ids.append(Chunk(pieces, r["piece"], r["base"], r["lo"], r["hi"], r["n"]).ids(r["a"], r["b"]))
                    else:
                        ids.append(edge_ids(pieces, r["piece"], r["cut"], r["last"], r["inner"], lo, hi, r["base"], r["n"], r["a"], r["b"]))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))], ["key", "k", "ids"])
            trim()

    traced = materialize(edges.drop("width", "finite").join(states, ["key", "k"]).mapInArrow(trace, "key long, k int, ids array<int>"), "pieces-traced")
    parts = traced.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return parts.select("key", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("token_ids"), F.size("parts").cast("long").alias("n_chunks"))


#: what ``encode`` can give of each text; ids_sha256 is over little-endian 32-bit ids
OUTPUTS = {"token_ids": (pa.list_(pa.int32()), ArrayType(IntegerType())), "n_tokens": (pa.int64(), "long"), "n_chunks": (pa.int64(), "long"), "ids_sha256": (pa.string(), "string"), "round_trip": (pa.bool_(), "boolean")}


def _outputs(lib, texts: list, ids: list, chunks, outputs: list[str]) -> list[pa.Array]:
    """Arrays of ``outputs``; null where the text is null."""
    given = {"n_chunks": lambda: chunks, "token_ids": lambda: ids, "n_tokens": lambda: map(len, ids)}
    given["ids_sha256"] = lambda: (hashlib.sha256(np.array(i, "<i4").tobytes()).hexdigest() for i in ids)
    given["round_trip"] = lambda: (back == (t or "").replace(SPACE, " ") for back, t in zip(lib.decode(ids), texts))
    return [pa.array([None if t is None else x for t, x in zip(texts, given[o]())], OUTPUTS[o][0]) for o in outputs]


def encode(docs: DataFrame, keep: list[str] | None = None, outputs: tuple[str, ...] = ("token_ids", "n_chunks"), path: str = MODEL, giant: int = GIANT, size: int = CHUNK) -> DataFrame:
    """``keep`` columns (all) of docs with ``outputs`` of each text; n_chunks is 1 unless the text is giant."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    docs = docs.select(F.col("text").alias("__text"), *keep)
    schema = StructType([docs.schema[c] for c in keep])
    for o in outputs:
        schema = schema.add(o, OUTPUTS[o][1])

    def run(batches):
        lib = _library(path)
        for batch in batches:
            at, sizes = 0, np.cumsum(_lengths(batch.column(0)))
            while at < batch.num_rows:
                # a few hundred KB at a time: ids are Python integers for a moment
                done = sizes[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(sizes, done + (1 << 18), "right")))
                part = batch.slice(at, stop - at)
                texts = part.column(0).to_pylist()
                ids = lib.encode([t or "" for t in texts], num_threads=1)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *_outputs(lib, texts, ids, [1] * len(ids), outputs)], schema.names)
                at = stop
            trim()

    def finish(batches):
        lib = _library(path)
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                text, ids, chunks = (part.column(c).to_pylist() for c in range(3))
                yield pa.RecordBatch.from_arrays([*part.columns[3:], *_outputs(lib, text, ids, chunks, outputs)], schema.names)
            trim()

    is_giant = F.coalesce(F.length("__text") > giant, F.lit(False))
    plain = docs.where(~is_giant).mapInArrow(run, schema)
    keyed = materialize(docs.where(is_giant).withColumn("__key", F.monotonically_increasing_id()), "pieces-giants")
    if not keyed.head(1):
        return plain
    ids = _giant_ids(keyed.select(F.col("__key").alias("key"), F.col("__text").alias("text")), path, size)
    ids = ids.select(F.col("key").alias("__key"), F.col("token_ids").alias("__ids"), F.col("n_chunks").alias("__chunks"))
    large = keyed.join(ids, "__key").select("__text", "__ids", "__chunks", *keep).mapInArrow(finish, schema)
    return plain.unionByName(large)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.binary_length(column).fill_null(0))


def decode(encoded: DataFrame, column: str = "decoded", path: str = MODEL) -> DataFrame:
    """``encoded`` with the text of token_ids."""
    names = encoded.columns

    def run(batches):
        lib = _library(path)
        for batch in batches:
            ids = batch.column(names.index("token_ids")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if i is None else lib.decode(i) for i in ids], pa.string())], [*names, column])
            trim()

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add(column, "string"))
