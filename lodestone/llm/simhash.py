"""SimHash near-duplicates by generalised pigeonhole search.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words with repeats; a bit is
1 if more than half of the shingles' XXH64 (seed 42) set it. Fewer than three words form one shingle;
no words give fingerprint zero, which links like any other.

Search: bits are grouped so that correlated bits share a partition. If the thresholds t_i of m
partitions sum to t - m + 1, two fingerprints within distance t are within t_i in some partition (-1:
never probed). A dynamic programme picks thresholds, and among m = 2, 3, 4 the cheapest plan, by
candidate counts: collisions of partition values are counted exactly over all fingerprints, those at
distance 1 follow from each bit's agreement. Probes meet the index by a join on (partition, value) and
candidates are verified by their differing bits.

Large buckets make no pairs. Fingerprints within distance 2 share a word at distance at most 1
from both, so members of a bucket over ``bucket`` distinct fingerprints emit their 65 such words and
join on these: at most 65 fingerprints meet at one word, and every link survives. Only the words'
components are needed, as links are closed over reachability.

Defined cases: null text is empty. Repeated rows and equal texts share a fingerprint and a component. A
null doc_id gets its component; it never is a component's id unless all ids there are null. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, trim
from .graph import components
from .words import LOWER

WIDTH = 64
_LOWER_TABLE = LOWER.tobytes()
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


#: shingles whose digests are held at a time
_BLOCK = 1 << 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text."""
    norm = b" ".join((text or "").encode("utf-8").translate(_LOWER_TABLE).split())
    if not norm:
        return 0
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    f = xxhash.xxh64_digest
    n = max(1, len(gaps) + 2 - size)
    starts = np.concatenate(([0], gaps + 1))[:n]
    ends = np.concatenate((gaps, [len(norm)]))[-n:]
    counts = np.zeros(WIDTH, np.int64)
    for at in range(0, n, _BLOCK):
        digests = b"".join([f(norm[s:e], 42) for s, e in zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())])
        table = np.frombuffer(digests, np.uint8).reshape(-1, 8)
        counts += np.concatenate([np.bincount(table[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints_of(texts: pa.Array) -> pa.Array:
    """The fingerprints of a column as signed longs."""
    return pa.array(np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), fingerprints_of(batch.column(1))], ["doc_id", "fp"])
            trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of jointly set bits, summed over all of them."""

    def run(batches):
        total, n = np.zeros((WIDTH, WIDTH)), 0
        for batch in batches:
            words = np.asarray(batch.column(0)).astype(np.int64)
            n += len(words)
            for at in range(0, len(words), 1 << 16):
                bits = np.unpackbits(words[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        at = np.arange(WIDTH * WIDTH + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total.ravel(), n))], ["at", "x"])

    rows = distinct.select("fp").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    x = np.array([r.x for r in rows]) if rows else np.zeros(WIDTH * WIDTH + 1)
    return int(x[-1]), x[:-1].reshape(WIDTH, WIDTH)


def group_bits(n: int, joint: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size; each grows by the bit most correlated with it."""
    p = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((joint / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(WIDTH)), []
    for k in range(m):
        size = WIDTH // m + (k < WIDTH % m)
        rest = sorted(free)
        own = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        free.discard(own[0])
        while len(own) < size:
            b = max(sorted(free), key=lambda b: (corr[b, own].sum(), -b))
            own.append(b)
            free.discard(b)
        groups.append(sorted(own))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds summing to ``total`` at least cost, by dynamic programming over partitions."""
    best = {0: (0.0, [])}
    for table in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for (s, (c, chosen)), (t, extra) in product(best.items(), table.items()):
            if s + t not in after or c + extra < after[s + t][0]:
                after[s + t] = (c + extra, [*chosen, t])
        best = after
    return best.get(total, (float("inf"), []))


def plan(distinct: DataFrame, distance: int = 2) -> list[tuple[int, int, list[int]]]:
    """(mask, threshold, bits) of every probed partition."""
    n, joint = bit_statistics(distinct)
    options = {m: group_bits(n, joint, m) for m in (2, 3, 4)}
    masks = [(m, k, mask_of(bits)) for m, groups in options.items() for k, bits in enumerate(groups)]
    each = distinct.select(F.explode(F.array(*[F.struct(F.lit(m * 10 + k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("val")) for m, k, mask in masks])).alias("x")).select("x.part", "x.val")
    squares = each.groupBy("part", "val").count().groupBy("part").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("s")).collect()
    same = {r.part: r.s for r in squares}
    p = np.diag(joint) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    chosen, low = None, float("inf")
    for m, groups in options.items():
        costs = []
        for k, bits in enumerate(groups):
            s = same.get(m * 10 + k, 0.0)
            near = s * (1 + sum((1 - agree[b]) / max(agree[b], 1e-9) for b in bits))
            costs.append({-1: 0.0, 0: 2 * n + s, 1: n * (len(bits) + 2) + near})
        cost, thresholds = allocate(costs, distance - m + 1)
        if cost < low:
            low, chosen = cost, [(mask_of(b), t, b) for b, t in zip(groups, thresholds) if t >= 0]
    return chosen or [(mask_of(b), 0, b) for b in options[3]]


def links(distinct: DataFrame, bucket: int = 64) -> DataFrame:
    """Edges (a, b) whose components equal those of all pairs of fingerprints within distance 2."""
    parts = plan(distinct)
    fp = F.col("fp")
    index = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), fp.bitwiseAND(F.lit(_signed(mask))).alias("val")) for k, (mask, _, _) in enumerate(parts)])).alias("x")).select("fp", "x.part", "x.val")
    sizes = index.groupBy("part", "val").agg(F.count("*").alias("size"))
    if all(t == 0 for _, t, _ in parts):
        sizes = sizes.where("size > 1")
    sized = materialize(index.join(sizes, ["part", "val"]), "simhash-index")
    small, large = sized.where(F.col("size") <= bucket), sized.where(F.col("size") > bucket)
    # within a bucket of bounded size: pairs by native array functions
    lists = small.groupBy("part", "val").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    pairs = lists.select(F.posexplode("fps").alias("i", "a"), "fps").select("a", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps"))).alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    edges = pairs.where(close)
    stars = large.select("fp").distinct().select(F.explode(F.array(F.col("fp"), *[fp.bitwiseXOR(F.lit(_signed(1 << b))) for b in range(WIDTH)])).alias("key"), "fp")
    probing = [(k, mask, bits) for k, (mask, t, bits) in enumerate(parts) if t > 0]
    if probing:
        probe = distinct.select(fp.alias("a"), F.explode(F.array(*[F.struct(F.lit(k).alias("part"), fp.bitwiseXOR(F.lit(_signed(1 << b))).alias("moved"), fp.bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(1 << b))).alias("val")) for k, mask, bits in probing for b in bits])).alias("x")).select("a", "x.part", "x.val", "x.moved")
        edges = edges.unionByName(probe.join(small.select("part", "val", F.col("fp").alias("b")), ["part", "val"]).where(close).select("a", "b"))
        stars = stars.unionByName(probe.join(large.select("part", "val").distinct(), ["part", "val"]).select(F.col("moved").alias("key"), F.col("a").alias("fp")))
    met = stars.groupBy("key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    via = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return edges.unionByName(via)


def classes(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root, further columns) of every row of ``distinct``; ``edges`` (a, b) link fingerprints."""
    reach = materialize(components(edges, "simhash-components"), "simhash-roots")
    return distinct.join(reach.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, bucket: int = 64) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row; ``root`` identifies the class of its fingerprint."""
    rows = materialize(fingerprints(docs), "simhash-rows")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    rooted = classes(distinct, links(distinct, bucket))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(smallest, "root"), "fp").select("doc_id", "fp", "root", "component_id")


def hex_of(column):
    """16 lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
