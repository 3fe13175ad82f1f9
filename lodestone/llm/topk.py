"""Exact top-k inner products over vectors in descending order of length.

Vectors are dealt to ranges of descending norm (and id, so that equal norms spread too). Each task turns its vectors
into an SVD-rotated basis (the eigenvectors of the table's Gram matrix, summed over all rows), in which most of an
inner product's mass lies in the first coordinates. Partial sums grow by a quarter of the coordinates at a time; after
each, a pair survives only if its partial sum plus the Cauchy-Schwarz bound on the rest (product of the residual
norms) reaches the query's threshold. Survivors get their exact integer product. As norms descend, a task is done
with its range once no query's norm bound reaches its threshold.

Thresholds are shared: a first pass over the longest vectors and a hash sample of one in ``sample_every`` finds each
query's k-th best score among them, a lower bound of the result. So in the full pass a task returns
only pairs that reach it, not a list for each query.

Queries are handled in chunks of bounded size (about ``query_chunk`` rows are broadcast at a time, by default 8192), whose
results are written one after the other; every query meets every row, in blocks. Nothing is capped.

Defined cases: a vector that is null, or holds a null or non-finite component, takes no part. Shorter
vectors count as padded with zeros. Equal scores rank by smaller vec_id; repeated rows with one vec_id
are each a candidate of other ids, and rows with the query's own vec_id are not. A query id with several
vectors is one query of all of them: its ranks are those of all their scores together. A null vec_id takes
no part. Scores past the range of a long are clamped to it. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, trim, work_dir

BLOCK = 2048
_EXACT = 2.0**53
_LONG = (1 << 63) - 1


def quantize(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v array<double>): floor(scale * x) of each component, as double; unusable rows go."""
    v = F.col(vector_col)
    usable = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: F.coalesce((x.cast("double") - x.cast("double")) == 0, F.lit(False)))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.call_function("floor", x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    if len(column):
        off = np.asarray(column.offsets)
        flat = np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64)
        size = np.diff(off)
        row = np.repeat(np.arange(len(column)), size)
        out[row, np.arange(off[0], off[-1]) - np.repeat(off[:-1], size)] = flat[off[0] : off[-1]]
    return out


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products of paired rows, as int64."""
    bound = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, q.shape[1])
    if bound < _EXACT:
        return np.einsum("ij,ij->i", q, v).astype(np.int64)
    return np.array([max(-_LONG - 1, min(_LONG, sum(int(a) * int(b) for a, b in zip(x, y)))) for x, y in zip(q, v)], np.int64)


class _Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -_LONG - 1, np.int64)
        self.id = np.full((n, k), _LONG, np.int64)
        self.full = np.zeros(n, np.int64)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Take hits, sorted here by query; returns the queries that changed."""
        order = np.lexsort((ids, ~score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        q, ids, score = (x[place < self.k] for x in (q, ids, score))
        who = np.unique(q)
        first = np.searchsorted(q, who)
        count = np.diff(np.append(first, len(q)))
        for u, a, n in zip(who, first, count):
            m = int(self.full[u])
            s = np.concatenate((self.score[u, :m], score[a : a + n]))
            i = np.concatenate((self.id[u, :m], ids[a : a + n]))
            keep = np.lexsort((i, ~s))[: self.k]
            self.full[u] = len(keep)
            self.score[u, : len(keep)], self.id[u, : len(keep)] = s[keep], i[keep]
        return who


def search(vectors: DataFrame, k: int = 5, query_every: int = 50, query_chunk: int = 8192, stages: int = 4, sample_every: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products with other rows.

    ``vectors`` has (id long, v array<double>) with integral values; queries are the rows whose id is
    divisible by ``query_every``.
    """
    spark = vectors.sparkSession
    none = "query_id long, rank int, vec_id long, score long"
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    order = [F.col("norm").desc(), F.col("id")]
    ready = materialize(vectors.withColumn("norm", norm).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order), "topk-vectors")
    dim = ready.agg(F.max(F.size("v"))).first()[0]
    if not dim:
        return spark.createDataFrame([], none)

    def gram(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column(0), dim)
            top = np.abs(m).max(initial=1)
            total += (m / top).T @ (m / top)
        at = np.arange(dim * dim)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "x"])

    sums = ready.select("v").mapInArrow(gram, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    _, basis = np.linalg.eigh(np.array([r.x for r in sums]).reshape(dim, dim))
    basis = np.ascontiguousarray(basis[:, ::-1])
    queries = ready.where(F.col("id") % query_every == 0).select("id", "v").dropDuplicates(["id", "v"])
    n = queries.count()
    if not n:
        return spark.createDataFrame([], none)
    many = 1 if n <= query_chunk else -(-n // query_chunk) * 2
    queries = materialize(queries.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")), "topk-queries")
    some = ready.where(F.pmod(F.xxhash64("id"), F.lit(sample_every)) == 0)
    ends = [dim * (s + 1) // stages for s in range(stages)]
    path = work_dir(spark, "topk-found")
    for c in range(many):
        table = queries.where(F.col("chunk") == c).select("id", "v").toArrow()
        q_ids, q = np.asarray(table["id"].combine_chunks()), _matrix(table["v"].combine_chunks(), dim)
        floor = np.full(len(q), -np.inf)
        # the sample's results are real candidates, so their k-th best is a bound below the k-th best of all
        for r in _best_of(_scan(some, spark.sparkContext.broadcast((q_ids, q, basis, floor)), k, ends), k, "at").where(F.col("rank") == k).select("at", "score").collect():
            floor[r["at"]] = r.score
        found = _scan(ready, spark.sparkContext.broadcast((q_ids, q, basis, floor)), k, ends)
        _best_of(found, k, "query_id").select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(none).parquet(path)


def _best_of(found: DataFrame, k: int, by: str) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scan(ready: DataFrame, shared, k: int, ends: list[int]) -> DataFrame:
    """(at, query_id, vec_id, score): of each task and query (at: its place), the ``k`` best pairs that reach the threshold."""

    def run(batches):
        q_ids, q, basis, floor = shared.value
        floor = floor.copy()
        rotated, q_norm = q @ basis, np.sqrt((q * q).sum(1))
        q_rest = [np.sqrt((rotated[:, e:] ** 2).sum(1)) for e in ends]
        best, slack, done = _Best(len(q), k), 1e-9, False
        for batch in batches:
            if done:
                continue  # norms only fall from here
            all_ids, all_v = np.asarray(batch.column(0)), _matrix(batch.column(1), q.shape[1])
            for lo in range(0, len(all_ids), BLOCK):
                ids, v = all_ids[lo : lo + BLOCK], all_v[lo : lo + BLOCK]
                longest = np.sqrt((v * v).sum(1)).max(initial=0)
                live = np.flatnonzero(q_norm * longest * (1 + slack) + 1 >= floor)
                if not len(live):
                    done = True
                    break
                turned = v @ basis
                v_rest = [np.sqrt((turned[:, e:] ** 2).sum(1)) for e in ends]
                for a in range(0, len(live), 512):
                    own = live[a : a + 512]
                    least = (floor[own] - 1 - slack * q_norm[own] * longest)[:, None]
                    sums, begin = np.zeros((len(own), len(v))), 0
                    for e, mine, theirs in zip(ends, q_rest, v_rest):
                        sums += rotated[own, begin:e] @ turned[:, begin:e].T
                        alive = sums + np.outer(mine[own], theirs) >= least
                        begin = e
                        # so few are left that exact products of them cost less than the next partial sums of all
                        if 16 * np.count_nonzero(alive) < alive.size:
                            break
                    qi, vi = np.nonzero(alive)
                    for c in range(0, len(qi), 1 << 16):
                        w, x = own[qi[c : c + (1 << 16)]], vi[c : c + (1 << 16)]
                        apart = q_ids[w] != ids[x]
                        w, x = w[apart], x[apart]
                        score = _products(q[w], v[x])
                        good = score >= floor[w]
                        for u in best.add(w[good], ids[x[good]], score[good]):
                            if best.full[u] == k:
                                floor[u] = max(floor[u], float(best.score[u, k - 1]) * (1 - 1e-12 * np.sign(best.score[u, k - 1])))
        n = best.full
        keep = np.arange(k)[None, :] < n[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), n)), pa.array(np.repeat(q_ids, n)), pa.array(best.id[keep]), pa.array(best.score[keep])], ["at", "query_id", "vec_id", "score"])
        trim()

    return ready.select("id", "v").mapInArrow(run, "at long, query_id long, vec_id long, score long")
