"""Training-corpus pipeline: language, near-duplicates, repeated passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, likeness, mixing, passages, pieces, simhash
from lodestone.llm.common import bounded_batches, materialize, read
from lodestone.llm.hashstore import pick

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: a language is accepted from this score on; chance is 1 / number of languages
LEAST_SCORE = 0.3
#: Jaccard similarity of five-word shingles from which texts are near-duplicates
LEAST_LIKENESS = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and those that no language fits; ``lang`` becomes the prediction."""
    bounded_batches(spark)
    found = langid.predict(docs.select(*COLUMNS), F.lit(True), [c for c in COLUMNS if c != "lang"])
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: that of the smallest doc_id (of repeated rows, one; of its texts, the smallest fingerprint).

    Classes are closed over two kinds of links: Jaccard similarity of at least 0.8 of the sets of five-word shingles,
    and fingerprints within two bits, as in op2. Rows are told apart by a number of their own, so rows that share a
    doc_id, or have none, and hold texts of different classes all stay.
    """
    bounded_batches(spark)
    rows = materialize(likeness.with_prints(docs.select(*COLUMNS)), "pipeline-prints")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp", "row")
    first = materialize(rows.groupBy("fp").agg(F.min(order).alias("first")), "pipeline-fingerprints")
    edges = simhash.links(first).unionByName(likeness.links(rows, LEAST_LIKENESS))
    kept = simhash.classes(first, edges).groupBy("root").agg(F.min("first").alias("x")).select("x.row")
    return pick(rows.select("row", *COLUMNS), kept, "pipeline-kept").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later occurrences of passages; a text that loses all its words goes."""
    bounded_batches(spark)
    cut = passages.cut(docs.select(*COLUMNS))
    return cut.where((F.col("n_removed") == 0) | (F.trim("text") != "")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps each document with the probability of its rate, at most once."""
    bounded_batches(spark)
    return mixing.chosen(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding gives it back."""
    bounded_batches(spark)
    return pieces.encode(docs, ["doc_id", "lang", "source"], ("n_tokens", "token_ids", "round_trip"))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("sentencepiece", tokens),
]

#: No stage can be stated in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
