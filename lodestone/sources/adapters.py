"""Tables as posts, questions' haystacks, queries and run events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: tables of long rows, whose work is per row
WIDE = ("documents", "pages", "conversations", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that a single small file would leave to fewer tasks than there are cores is dealt out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in WIDE and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as posts; confidence from quality, completeness from toxic."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = docs.join(labels.select(F.col("doc_id").alias("_id"), "quality", "toxic"), F.col("doc_id") == F.col("_id"), "left")
    return j.select(
        F.col("source").alias("platform"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
        "text",
        F.lit("待识别").alias("company"),
        F.col("lang").alias("business"),
        F.lit("").alias("date"),
        F.when(F.col("quality") == 1, "A").when(F.col("quality") == 0, "C").otherwise("B").alias("confidence"),
        F.lit("").alias("keyword"),
        F.lit("").alias("collected_at"),
        F.lit("direct").alias("source_type"),
        F.lit("text").alias("collection_depth"),
        F.lit(0).alias("expected_image_count"),
        F.lit(0).alias("downloaded_image_count"),
        F.lit(0).alias("ocr_page_count"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("is_complete"),
        F.col("doc_id").alias("ordinal"),
    )


def conversation_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post a conversation: each turn is a page marker line, then its text."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.concat(F.lit("[图片OCR 第"), (F.col("turn") + 1).cast("string"), F.lit("页]\n"), F.col("text")).alias("t")))).alias("x")
    )
    return turns.select(F.col("conv_id").alias("ordinal"), F.array_join(F.transform("x", lambda s: s["t"]), "\n").alias("text"))


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a run log: run, item, kind (done, failed, finish), in order of (ts, event_id)."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "finish").otherwise("done")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.concat(F.lit("web:url:"), F.get_json_object("props", "$.k")).alias("item"), kind.alias("kind"), "ts", "event_id", F.col("event_type").alias("error"))
