"""Hybrid search: lexical, regular-expression and hashed-vector recall fused by reciprocal rank.

Questions are a table (ordinal, haystack, quality_score, ...), queries a stated set (query_id, query). Postings
joins score only pairs with a common term. Ranks are global within a query, yet no query's pairs are sorted in
one task: a document can reach the k best only with a rank up to 60 + 2k in some list, so the best of each
list are found by a pushed-down group limit, and the ranks of these few in the other list follow from counts
of better pairs, which combine map-side.

Queries go in blocks of at most ``CHUNK``: what is broadcast or gathered of a block has a bound, however many queries
there are.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.classify import regex_hit
from ..functions.text import terms
from .keep import keep

RRF = 60
DIMENSIONS = 1024
#: queries of a block
CHUNK = 1024


def _dim(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode("utf-8"), digest_size=8).digest(), "little") % DIMENSIONS


@F.pandas_udf(IntegerType())
def blake_dim(term: pd.Series) -> pd.Series:
    """Feature hash of a term; called on distinct terms only."""
    return term.map(_dim, na_action="ignore").astype("int32")


def md5_dim(term: Column) -> Column:
    """The same from the first three hex digits of md5, within the JVM and any SQL engine."""
    return F.conv(F.substring(F.md5(term), 1, 3), 16, 10).cast("int") % DIMENSIONS


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)."""
    return texts.select(key, F.explode(terms(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def with_dims(post: DataFrame, encoder: str = "blake2b") -> DataFrame:
    """``post`` with dim; the Python hash sees each distinct term once."""
    if encoder == "md5":
        return post.withColumn("dim", md5_dim(F.col("term")))
    if encoder != "blake2b":
        raise ValueError(f"unknown encoder {encoder}")
    dims = post.select("term").distinct().withColumn("dim", blake_dim("term"))
    return post.join(dims, "term")


def vectors(post: DataFrame, key: str, encoder: str = "blake2b") -> DataFrame:
    """(key, dim, w): hashed term counts."""
    return with_dims(post, encoder).groupBy(key, "dim").agg(F.sum("tf").alias("w"))


def overlap(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, ordinal, overlap) of pairs with a common term; from postings of both."""
    sizes = queries.groupBy("query_id").agg(F.count("*").alias("n"))
    shared = docs.select("ordinal", "term").join(queries.select("query_id", "term"), "term").groupBy("query_id", "ordinal").agg(F.count("*").alias("shared"))
    return shared.join(sizes, "query_id").select("query_id", "ordinal", (F.col("shared") / F.col("n")).alias("overlap"))


def blocks(queries: DataFrame, chunk: int = CHUNK) -> list[DataFrame]:
    """``queries`` in parts of about half of ``chunk`` by hash of their id, or whole where they are as few as ``chunk``."""
    n = queries.count()
    if n <= chunk:
        return [queries]
    many = -(-n // chunk) * 2
    stored = keep(queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(many))))
    return [stored.where(F.col("_block") == b).drop("_block") for b in range(many)]


def exact(questions: DataFrame, queries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(query_id, ordinal) where the haystack contains the query; a block of queries travels as one row."""
    return reduce(DataFrame.unionByName, [_exact(questions, block) for block in blocks(queries, chunk)])


def _exact(questions: DataFrame, queries: DataFrame) -> DataFrame:
    given = queries.groupBy().agg(F.collect_list(F.struct("query_id", F.lower("query").alias("q"))).alias("given"))
    low = questions.select("ordinal", F.lower("haystack").alias("h")).join(F.broadcast(given))
    return low.select("ordinal", F.explode(F.filter("given", lambda g: F.col("h").contains(g["q"]))).alias("g")).select("g.query_id", "ordinal")


def lexical(questions: DataFrame, queries: DataFrame, doc_posts: DataFrame, query_posts: DataFrame, grep_pattern: str | None = None) -> DataFrame:
    """(query_id, ordinal, score) of positive scores: term overlap, plus 1 for the phrase, plus 1 for the pattern."""
    # each part in a column of its own: the sum has one order, and so one rounding
    row = lambda o, e, r: [F.lit(x).cast("double").alias(n) if isinstance(x, float) else x.alias(n) for x, n in ((o, "o"), (e, "e"), (r, "r"))]
    parts = overlap(doc_posts, query_posts).select("query_id", "ordinal", *row(F.col("overlap"), 0.0, 0.0))
    parts = parts.unionByName(exact(questions, queries).select("query_id", "ordinal", *row(0.0, 1.0, 0.0)))
    if grep_pattern:
        hits = questions.where(regex_hit("haystack", grep_pattern)).select("ordinal")
        for block in blocks(queries):
            ids = block.groupBy().agg(F.collect_list("query_id").alias("ids"))
            parts = parts.unionByName(hits.join(F.broadcast(ids)).select(F.explode("ids").alias("query_id"), "ordinal", *row(0.0, 0.0, 1.0)))
    whole = parts.groupBy("query_id", "ordinal").agg(F.max("o").alias("o"), F.max("e").alias("e"), F.max("r").alias("r"))
    return whole.select("query_id", "ordinal", (F.col("o") + F.col("e") + F.col("r")).alias("score"))


def cosine(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, ordinal, score) of hashed vectors with a common dimension."""
    norm = lambda v, key: v.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = docs.join(queries.withColumnRenamed("w", "qw"), "dim").groupBy("query_id", "ordinal").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    out = dot.join(norm(docs, "ordinal"), "ordinal").join(norm(queries, "query_id").withColumnRenamed("norm", "qn"), "query_id")
    return out.select("query_id", "ordinal", (F.col("dot") / (F.col("norm") * F.col("qn"))).alias("score"))


def dense(docs: DataFrame, queries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(query_id, ordinal, score): dot products of (key, v array<double>); a block of queries travels as one row."""
    return reduce(DataFrame.unionByName, [_dense(docs, block) for block in blocks(queries, chunk)])


def _dense(docs: DataFrame, queries: DataFrame) -> DataFrame:
    given = queries.groupBy().agg(F.collect_list(F.struct("query_id", F.col("v").alias("q"))).alias("given"))
    each = docs.join(F.broadcast(given)).select("ordinal", "v", F.explode("given").alias("g"))
    dot = F.aggregate(F.zip_with("v", "g.q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return each.select(F.col("g.query_id").alias("query_id"), "ordinal", dot.alias("score"))


def best(scored: DataFrame, most: int) -> DataFrame:
    """``scored`` with rank, of each query's ``most`` best; on equal scores the larger ordinal is first."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("ordinal").desc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _ranks(scored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, ordinal, score, rank) of ``wanted`` pairs that ``scored`` has: better pairs are counted."""
    kinds = dict(scored.dtypes)
    if kinds["ordinal"] == "bigint" and kinds["query_id"] == "bigint":
        return _numeric_ranks(scored, wanted)
    key = F.struct("score", "ordinal")
    own = scored.join(F.broadcast(wanted), ["query_id", "ordinal"]).select("query_id", key.alias("k"))
    lists = keep(own.groupBy("query_id").agg(F.array_sort(F.collect_list("k")).alias("ks")))
    # how many wanted keys lie below each pair, counted once for each query and number
    below = scored.join(F.broadcast(lists), "query_id").select("query_id", F.size(F.filter("ks", lambda k: k < key)).alias("below")).groupBy("query_id", "below").agg(F.count("*").alias("n"))
    counts = below.groupBy("query_id").agg(F.collect_list(F.struct("below", "n")).alias("counts"))
    each = lists.join(counts, "query_id").select("query_id", F.posexplode("ks").alias("at", "k"), "counts")
    better = F.aggregate(F.filter("counts", lambda c: c["below"] > F.col("at")), F.lit(0).cast("long"), lambda a, c: a + c["n"])
    return each.select("query_id", F.col("k.ordinal").alias("ordinal"), F.col("k.score").alias("score"), (better + 1).cast("int").alias("rank"))


def _numeric_ranks(scored: DataFrame, wanted: DataFrame) -> DataFrame:
    """``_ranks`` for long keys: each task sorts its pairs and all wanted ones together and counts in one pass.

    The wanted pairs are at most 2 (60 + 2k) a query; tasks return one count for each.
    """
    own = scored.join(F.broadcast(wanted), ["query_id", "ordinal"]).select("query_id", "score", "ordinal").toArrow()
    q, s, o = (own[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("query_id", "score", "ordinal"))
    shared = scored.sparkSession.sparkContext.broadcast((q, s, o))

    def count(batches):
        q, s, o = shared.value
        better = np.zeros(len(q), np.int64)
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            both = [np.concatenate((x, own)) for x, own in zip(columns, (q, s, o))]
            n = batch.num_rows
            wanted_here = np.arange(len(both[0])) >= n
            # by query, then from worst to best; a wanted pair stands behind itself
            order = np.lexsort((wanted_here, both[2], both[1], both[0]))
            upto = np.cumsum(~wanted_here[order])
            last = np.searchsorted(both[0][order], both[0][order], "right") - 1
            after = upto[last] - upto
            place = order[wanted_here[order]] - n
            better[place] += after[wanted_here[order]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), pa.array(better)], ["at", "better"])

    counts = scored.select("query_id", "score", "ordinal").mapInArrow(count, "at long, better long").groupBy("at").agg(F.sum("better").alias("better")).toArrow()
    better = np.zeros(len(q), np.int64)
    better[counts["at"].combine_chunks().to_numpy()] = counts["better"].combine_chunks().to_numpy()
    table = pa.table({"query_id": pa.array(q, pa.int64()), "ordinal": pa.array(o, pa.int64()), "score": pa.array(s, pa.float64()), "rank": pa.array(better + 1, pa.int32())})
    return scored.sparkSession.createDataFrame(table)


def fuse(grep: DataFrame, vector: DataFrame, quality: DataFrame, top_k: int = 20) -> DataFrame:
    """(query_id, ordinal, place, score, grep, vector): reciprocal-rank fusion of two score tables, top k.

    Only positive scores count. Ties order by quality, then documents with a lexical score by its rank, then the
    others by vector rank.
    """
    k = max(1, top_k)
    grep, vector = grep.where("score > 0"), vector.where("score > 0")
    reach = RRF + 2 * k
    wanted = keep(best(grep, reach).select("query_id", "ordinal").unionByName(best(vector, reach).select("query_id", "ordinal")).distinct())
    g, v = (_ranks(x, wanted).select("query_id", "ordinal", F.col("score").alias(n), F.col("rank").alias(f"{n}_rank")) for x, n in ((grep, "grep"), (vector, "vector")))
    both = g.join(v, ["query_id", "ordinal"], "full").join(quality.select("ordinal", "quality_score"), "ordinal")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(RRF) + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf", part("grep_rank") + part("vector_rank"))
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), F.col("quality_score").desc(), F.col("grep_rank").isNull(), F.coalesce("grep_rank", "vector_rank"))
    out = both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return out.select("query_id", "ordinal", "place", F.round("rrf", 8).alias("score"), F.round("grep", 6).alias("grep"), F.round("vector", 6).alias("vector"))


def unit(v) -> Column:
    """A vector scaled to length 1 (a zero vector stays), as doubles."""
    v = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def hybrid_search(
    questions: DataFrame, queries: DataFrame, *, top_k: int = 20, grep_pattern: str | None = None, encoder: str = "blake2b", doc_posts: DataFrame | None = None, chunk: int = CHUNK
) -> DataFrame:
    """Fused results for each query. Postings may be given, as a library stores them.

    Encoders ``blake2b`` and ``md5`` hash terms; ``dense`` takes the vectors of a sentence encoder, which both tables then
    hold in a column ``embedding``.
    """
    docs = doc_posts if doc_posts is not None else keep(postings(questions, "ordinal", "haystack"))
    doc_vectors = questions.select("ordinal", unit(F.col("embedding")).alias("v")) if encoder == "dense" else keep(vectors(docs, "ordinal", encoder))
    found = []
    for block in blocks(queries, chunk):
        # read several times each: postings by both recalls, scores by ranks of candidates and counts of better pairs
        asked = keep(postings(block, "query_id", "query"))
        grep = keep(lexical(questions, block, docs, asked, grep_pattern))
        if encoder == "dense":
            vector = _dense(doc_vectors, block.select("query_id", unit(F.col("embedding")).alias("v")))
        else:
            vector = keep(cosine(doc_vectors, vectors(asked, "query_id", encoder)))
        found.append(fuse(grep, vector, questions, top_k))
    return reduce(DataFrame.unionByName, found)
