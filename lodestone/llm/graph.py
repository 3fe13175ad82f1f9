"""Connected components of an edge table, by local contraction and alternating star operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _contract(batches):
    """Spanning stars (vertex, smallest vertex) of one partition's edges, by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
    verts = list(parent)
    tops = [root(v) for v in verts]
    v, t = np.array(verts, np.int64), np.array(tops, np.int64)
    keep = v != t
    yield pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(t[keep])], ["a", "b"])


def components(edges: DataFrame, what: str = "components", rounds: int = 60) -> DataFrame:
    """(vertex, root) of every vertex with an edge; root is the smallest vertex that it reaches.

    ``edges`` has long columns a, b. Each round contracts every partition to spanning stars, then does a
    large-star and a small-star step (minimum by partial aggregation, then a join that adaptive
    execution splits at hot vertices) and writes the shared folder. It ends when a round
    changes nothing.
    """
    now = materialize(edges.where("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long"), what)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours of a hang on its smallest neighbour
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: smaller neighbours of a, and a itself, hang on its smallest neighbour
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        after = materialize(small.select("e.a", "e.b").where("a <> b").distinct(), what)
        sums = [x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first() for x in (now, after)]
        now = after
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError("components did not converge")
    tops = now.select("b").distinct()
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(tops.select(F.col("b").alias("vertex"), F.col("b").alias("root")))
