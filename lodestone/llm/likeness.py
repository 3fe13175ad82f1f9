"""Links between texts whose sets of word shingles have a Jaccard similarity of at least ``least``.

Words and case are those of ``simhash``; shingles have five words, and fewer words form one shingle. Texts
of one set share a signature, a 64-bit hash of the set; each signature is compared once.

Candidates share one of ``BANDS`` min-hash keys of ``WIDTH`` minima each: a pair of similarity 0.8 is missed with
probability 0.0005, one of 0.9 with less than 1e-8. Buckets make no pairs and are never gathered: each signature
hangs on its bucket's smallest, and the components of these stars are compared set by set, exactly. Within a component only links that join
two classes matter, so sets are compared with those not yet reached. A component over ``chunk`` sets is dealt to
tiles of two chunks, so that it spreads over tasks.

Defined cases: null text is empty; a text without words has the empty set, like only to itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import materialize, text_slices, trim
from .graph import components
from .hashstore import Rows
from .simhash import fingerprints_of
from .words import mix, split_words

SIZE = 5
BANDS, WIDTH = 25, 6
_EDGE = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, pointer): the sorted distinct shingles of text i at pointer[i]:pointer[i+1]."""
    _, _, words, pointer = split_words(data, offsets, lower=True)
    n = np.diff(pointer)
    each = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), each)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each) + pointer[:-1][doc]
    stop = pointer[1:][doc]
    h = np.zeros(len(doc), np.uint64)
    for k in range(size):
        inside = at + k < stop
        h = mix(h + _EDGE + np.where(inside, words[np.minimum(at + k, len(words) - 1)] if len(words) else 0, np.uint64(k)))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def sketch(h: np.ndarray, pointer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, keys of the bands) of each set."""
    n = len(pointer) - 1
    keys = np.zeros((n, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(pointer) > 0)
    sig = np.zeros(n, np.uint64)
    if len(full):
        start = pointer[:-1][full]
        sig[full] = mix(np.add.reduceat(mix(h + _EDGE), start) + np.diff(pointer)[full].astype(np.uint64))
        for band in range(BANDS):
            key = np.full(len(full), band, np.uint64)
            for k in range(band * WIDTH, (band + 1) * WIDTH):
                a, b = mix(np.array([2 * k + 1, 2 * k + 2]))
                x = (h ^ b) * (a | np.uint64(1))
                x ^= x >> np.uint64(32)
                key = mix(key + np.minimum.reduceat(x * (b | np.uint64(1)), start))
            keys[full, band] = key
    return sig, keys


def with_prints(docs: DataFrame) -> DataFrame:
    """``docs`` with row (a number of its own), fp (SimHash), sig and keys (empty for a text without words).

    Rows are numbered by place, so the result is to be written before it is read twice. Columns of these names are replaced.
    """
    names = [c for c in docs.columns if c not in ("row", "fp", "sig", "keys")]
    docs = docs.select(*names, F.monotonically_increasing_id().alias("row"))

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(names.index("text"))):
                part = batch.slice(i, j - i)
                h, pointer = shingle_sets(data, offsets)
                sig, keys = sketch(h, pointer)
                size = np.where(np.diff(pointer) > 0, BANDS, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(keys[size > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, fingerprints_of(part.column(names.index("text"))), pa.array(sig.view(np.int64)), lists], [*names, "row", "fp", "sig", "keys"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("fp", "long").add("sig", "long").add("keys", ArrayType(LongType())))


def _sets(rows: DataFrame, alike: DataFrame) -> DataFrame:
    """(root, sig, fp, chunks, shingles) of the rows (row, text) that ``alike`` (row, root, sig, fp, chunks) names."""
    store = Rows(alike.select("row", "root", "sig", "fp", "chunks"), "likeness-rows")

    def run(batches):
        for batch in batches:
            found, values = store.find(batch.column(0).to_numpy())
            for i, j, data, offsets in text_slices(batch.column(1).filter(pa.array(found))):
                h, pointer = shingle_sets(data, offsets)
                lists = pa.LargeListArray.from_arrays(pa.array(pointer.astype(np.int64)), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array(v[i:j]) for v in values), lists], ["root", "sig", "fp", "chunks", "shingles"])

    return rows.select("row", "text").mapInArrow(run, "root long, sig long, fp long, chunks long, shingles array<long>")


def reached(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (i, j) whose components are those of all pairs with a similarity of at least ``least``."""
    size = np.array([len(s) for s in sets])
    left, out = list(range(len(sets))), []
    while left:
        todo = [left.pop()]
        while todo and left:
            x = todo.pop()
            others = np.array(left)
            fits = others[(size[others] >= least * size[x]) & (size[others] * least <= size[x])]
            if not len(fits):
                continue
            tokens = np.concatenate([sets[i] for i in fits])
            place = np.minimum(np.searchsorted(sets[x], tokens), size[x] - 1)
            first = np.cumsum(size[fits]) - size[fits]
            both = np.add.reduceat((sets[x][place] == tokens).astype(np.int64), first)
            near = fits[both >= least * (size[x] + size[fits] - both) - 1e-9]
            out += [(x, int(i)) for i in near]
            todo += near.tolist()
            gone = set(near.tolist())
            left = [i for i in left if i not in gone]
    return out


def links(rows: DataFrame, least: float = 0.8, chunk: int = 1024) -> DataFrame:
    """Edges (a, b) between the fp of rows (row, text, fp, sig, keys): those of equal sets and of sets that are alike."""
    own = materialize(rows.groupBy("fp", "sig").agg(F.min("row").alias("row")), "likeness-signatures")
    first = materialize(own.groupBy("sig").agg(F.min(F.struct("fp", "row")).alias("x")).select("sig", F.col("x.fp").alias("low"), F.col("x.row").alias("row")), "likeness-first")
    same = own.join(first.select("sig", "low"), "sig").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    # the first row of each signature speaks for it
    each = rows.select("row", "keys").join(first.select("row", "sig"), "row").select("sig", F.explode("keys").alias("key"))
    each = materialize(each, "likeness-keys")
    shared = each.groupBy("key").agg(F.min("sig").alias("a"), F.max("sig").alias("z")).where("a < z").select("key", "a")
    stars = each.join(shared, "key").where("sig <> a").select("a", F.col("sig").alias("b"))
    alike = materialize(components(stars, "likeness-components").withColumnRenamed("vertex", "sig").join(first, "sig"), "likeness-roots")
    n = alike.groupBy("root").agg(F.ceil(F.count("*") / chunk).cast("long").alias("chunks"))
    # texts stay where they are; only their sets move, and those of rows that are like none don't
    dealt = _sets(rows, alike.withColumnRenamed("low", "fp").join(n, "root")).withColumn("chunks", F.col("chunks").cast("int")).withColumn("own", F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int"))
    # chunk i meets chunk j in tile (i, j); the one chunk of a small component is tile (0, 0)
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: k != F.col("own")))
    tiles = dealt.withColumn("other", F.explode(other)).select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sig", "fp", "shingles")

    def run(key, table):
        fp = table["fp"].combine_chunks().to_numpy()
        found = reached([np.sort(s.values.to_numpy().view(np.uint64)) for s in table["shingles"].combine_chunks()], least)
        x = np.array(found, np.int64).reshape(-1, 2)
        trim()
        return pa.table({"a": pa.array(fp[x[:, 0]]), "b": pa.array(fp[x[:, 1]])})

    near = materialize(tiles.groupBy("root", "i", "j").applyInArrow(run, "a long, b long").where("a <> b"), "likeness-links")
    return same.unionByName(near)
