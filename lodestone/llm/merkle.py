"""Document fingerprints: a Merkle tree over phrases, paragraphs and sections.

A text splits into lines (paragraphs), and blank lines close a section. A paragraph splits into
phrases of a few words at content-defined cuts, so an insertion moves only the phrases around it.
Each node's digest is blake2b over its children's digests; a leaf's is XXH64 of the phrase. Equal
roots mean equal texts; descending into differing children locates edits (``diff``).

``fingerprint_with_next`` finds the edit of each edited text that way: ``edit_start`` is the first character, and
``edit_chars`` the number of characters, of the branches of the text's tree that the edited text's tree lacks.

The fingerprint string is ``<root>.<sketch>``. The sketch keeps, for each of 128 ranges of leaf hashes,
16 bits of the smallest leaf, so the likeness of two fingerprints estimates the Dice share of phrases
that both texts have (nearly exact for texts of few phrases). Likeness is 1.0 exactly when the roots are equal.

Defined cases: a null text is the empty text; the empty text has one empty section. Rows of equal
doc_id follow each other in order of their text's hash, so a repeated row's neighbour is its twin. A null doc_id sorts
last in descending order. An empty table gives no rows; a single row is its own neighbour. Without an edit, edit_start
is null. Other columns are ignored.

Rows go to tasks by ranges of (doc_id, hash of the text): one doc_id, or null, that holds many rows spreads over as many
ranges as it has shares. Only rows of one id and one text stay together.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, trim

BINS = 128
#: A phrase ends at white space after a character whose code point is a multiple of 3, or after 48 characters.
_CUT = "".join(re.escape(chr(c)) for c in range(0x21, 0x250) if c % 3 == 0)
_PHRASE = re.compile(rf"[^\n]{{1,48}}?(?<=[{_CUT}])[ \t]+|[^\n]{{1,48}}|\n")
_LIKE_BELOW_ONE = 1 - 2**-10


class Tree:
    """Digests of a text's phrases, paragraphs, sections and of the whole, with their places."""

    def __init__(self, text: str):
        self.leaves, self.ends = bytearray(), array("q")
        self.paragraphs, self.sections = [], []  # (digest, first child, end child, first character, end character)
        first = first_of_section = p_start = s_start = 0
        h = xxhash.xxh64_digest
        for m in _PHRASE.finditer(text):
            if m[0] != "\n":
                self.leaves += h(m[0])
                self.ends.append(m.end())
                continue
            n, empty = len(self.ends), len(self.ends) == first
            self.paragraphs.append((_digest(self.leaves[8 * first : 8 * n]), first, n, p_start, m.start()))
            first, p_start = n, m.end()
            if empty:  # a blank line closes a section
                self._close(first_of_section, s_start, m.start())
                first_of_section, s_start = len(self.paragraphs), m.end()
        self.paragraphs.append((_digest(self.leaves[8 * first :]), first, len(self.ends), p_start, len(text)))
        self._close(first_of_section, s_start, len(text))
        self.root = Node(_digest(b"".join(x[0] for x in self.sections)), 0, len(text), self, 0, (0, len(self.sections)))

    def _close(self, first: int, start: int, end: int) -> None:
        own = self.paragraphs[first:]
        self.sections.append((_digest(b"".join(x[0] for x in own)), first, len(self.paragraphs), start, end))


class Node:
    """A node's digest and its character range; children are made when asked for (none for a phrase)."""

    __slots__ = ("digest", "start", "end", "tree", "level", "span")

    def __init__(self, digest: bytes, start: int, end: int, tree: Tree, level: int, span: tuple[int, int]):
        self.digest, self.start, self.end, self.tree, self.level, self.span = digest, start, end, tree, level, span

    @property
    def children(self) -> list["Node"]:
        t, (lo, hi) = self.tree, self.span
        if self.level < 2:
            below = (t.sections, t.paragraphs)[self.level][lo:hi]
            return [Node(d, start, end, t, self.level + 1, (a, b)) for d, a, b, start, end in below]
        if self.level == 2:
            return [Node(bytes(t.leaves[8 * k : 8 * k + 8]), self.start if k == lo else t.ends[k - 1], t.ends[k], t, 3, (0, 0)) for k in range(lo, hi)]
        return []


def _digest(children: bytes) -> bytes:
    return hashlib.blake2b(children, digest_size=16).digest()


def build_tree(text: str | None) -> Node:
    """The root of a text's tree, for locating edits."""
    return Tree(text or "").root


def diff(a: Node, b: Node) -> list[tuple[int, int]]:
    """Character ranges of ``a`` whose nodes have no equal in ``b``; equal branches are never opened."""
    if a.digest == b.digest:
        return []
    mine, theirs = a.children, b.children
    if not mine or not theirs:
        return [(a.start, a.end)]
    left: dict[bytes, int] = {}
    for x in theirs:
        left[x.digest] = left.get(x.digest, 0) + 1
    odd = []
    for x in mine:
        if left.get(x.digest, 0):
            left[x.digest] -= 1
        else:
            odd.append(x)
    rest = []
    for x in theirs:  # those of b that found no equal in a
        if left.get(x.digest, 0):
            left[x.digest] -= 1
            rest.append(x)
    if len(odd) == len(rest):
        return [r for x, y in zip(odd, rest) for r in diff(x, y)]
    return [(x.start, x.end) for x in odd]


def fingerprint(text: str | Node | None) -> str:
    node = text if isinstance(text, Node) else build_tree(text)
    sketch = np.zeros(BINS, ">u2")
    if node.tree.ends:
        h = np.unique(np.frombuffer(node.tree.leaves, ">u8"))
        bins = (h >> np.uint64(57)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        sketch[bins[first]] = (h[first] & np.uint64(0xFFFF)) | np.uint64(1)  # 0 marks an empty range
    return f"{node.digest.hex()}.{sketch.tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Share of common phrases (Dice) estimated from two fingerprints alone, 0 to 1."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[33:]), ">u2") for s in (a, b))
    either = np.count_nonzero((x > 0) | (y > 0))
    both = np.count_nonzero((x == y) & (x > 0))
    jaccard = both / either if either else 0.0
    return min(_LIKE_BELOW_ONE, 2 * jaccard / (1 + jaccard))


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``following``."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k] if k else text


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_start long, edit_chars long"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _row(doc_id, text: str, tree: Node, own: str, following: str, next_print: str) -> tuple:
    changed = edited(text, following)
    other = build_tree(changed)
    changed_print = fingerprint(other)
    lost = diff(tree, other)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, own, changed_print, likeness(own, changed_print), likeness(own, next_print), lost[0][0] if lost else None, sum(b - a for a, b in lost)


def _pairs(batches):
    """Rows arrive by bucket, in order; each is emitted when its follower is known."""
    held = None  # (bucket, doc_id, text, tree, fingerprint)
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(c) for c in ("bucket", "doc_id", "text", "ahead")]
        for k in range(batch.num_rows):
            bucket, doc_id, text, ahead = (c[k].as_py() for c in columns)
            text = text or ""
            if held is not None and held[0] != bucket:
                held = None
            tree = build_tree(text)
            own = fingerprint(tree)
            if held is not None:
                out.append(_row(*held[1:], text, own))
            held = None if ahead else (bucket, doc_id, text, tree, own)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(_TYPES), _TYPES)], _NAMES)
        trim()


def _above(cuts: list[int], x, or_equal: bool):
    """How many of the falling ``cuts`` are above ``x`` (or equal): whole groups first, then within the next one."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    over = (lambda c: c >= x) if or_equal else (lambda c: c > x)
    whole = F.size(F.filter(F.lit([g[-1] for g in groups]), over))
    rest = F.size(F.filter(F.get(F.array(*[F.lit(g) for g in groups]), whole), over))
    return whole * width + F.greatest(F.coalesce(rest, F.lit(0)), F.lit(0))


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and likeness to the next text by descending id.

    Rows are dealt to ranges of (doc_id, text hash), as many as there are shuffle partitions. A copy of the first row of
    each range also goes, marked as look-ahead, to the range above it, whose last row needs it. So
    each text moves once and no window runs over the whole table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    n = shuffle_partitions(spark)
    rows = docs.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nameless")).first()
    if not rows.n:
        return spark.createDataFrame([], _OUT)
    cuts = docs.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 and rows.nameless < rows.n else []
    cuts = sorted((int(c) for c in cuts), reverse=True)
    # an id that is a cut several times has as many ranges, by the hash of the text; null ids come last
    nameless = -(-rows.nameless * n // rows.n)
    part = F.col("h").cast("double") / 2.0**64 + 0.5
    share = lambda m: F.least(F.floor(part * m), m - 1).cast("int")
    above = _above(cuts, F.col("doc_id"), False)
    many = F.greatest(_above(cuts, F.col("doc_id"), True) - above, F.lit(1))
    bucket = F.when(F.col("doc_id").isNull(), len(cuts) + 1 + share(F.lit(max(1, nameless)))).otherwise(above + share(many)).cast("int")
    place = F.struct(F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("falling"), "h")
    dealt = docs.withColumn("bucket", bucket).withColumn("place", place)
    heads = dealt.groupBy("bucket").agg(F.min("place").alias("place")).orderBy("bucket").collect()
    order = [r.bucket for r in heads]
    # the range that looks ahead to each one; the last to the first
    looks = [(r.bucket, tuple(r.place), order[i - 1]) for i, r in enumerate(heads)]
    looks = F.broadcast(spark.createDataFrame(looks, "bucket int, place struct<falling: long, h: long>, to int"))
    ahead = dealt.join(looks, ["bucket", "place"]).groupBy("to").agg(F.min("text").alias("text"))
    moved = dealt.select("doc_id", "text", "h", "bucket", F.lit(False).alias("ahead"))
    moved = moved.unionByName(ahead.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("h"), F.col("to").alias("bucket"), F.lit(True).alias("ahead")))
    moved = moved.repartitionById(len(cuts) + 1 + max(1, nameless), F.col("bucket")).sortWithinPartitions("bucket", "ahead", F.col("doc_id").desc_nulls_last(), "h", "text")
    return moved.drop("h").mapInArrow(_pairs, _OUT)


__all__ = ["Node", "Tree", "build_tree", "diff", "edited", "fingerprint", "fingerprint_with_next", "likeness"]
