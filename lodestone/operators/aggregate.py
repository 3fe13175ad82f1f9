"""Aggregation of clustered candidate rows to questions with sources, confidence and quality score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import short_id

#: fixed values of the quality score
BASE = {"A": 0.90, "B": 0.72, "C": 0.52}
BASE_OTHER, BONUS, BONUS_MOST, PENALTY = 0.45, 0.03, 0.10, 0.08
RANK = {"A": 0, "B": 1, "C": 2}


def confidence_rank(level: Column) -> Column:
    return F.coalesce(*[F.when(level == k, v) for k, v in RANK.items()], F.lit(9))


def quality_score(confidence: Column, frequency: Column, all_incomplete: Column) -> Column:
    base = F.coalesce(*[F.when(confidence == k, v) for k, v in BASE.items()], F.lit(BASE_OTHER))
    bonus = F.least(F.lit(BONUS_MOST), F.lit(BONUS) * (frequency - 1))
    score = base + bonus - F.when(all_incomplete, PENALTY).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


#: array column of a question, by row column
ARRAYS = {"company": "companies", "platform": "platforms", "business": "businesses"}


def questions(rows: DataFrame) -> DataFrame:
    """Questions of (cluster, seq, norm, question, topic, company, business, platform, confidence, source_id, source).

    ``source`` is a struct with at least is_complete (missing counts as complete). Array columns come from all
    rows of a cluster; frequency and the incomplete penalty from its kept sources, which are the first row of each
    source. An empty company, platform or business is kept only from the first row.

    Rows are read once: aggregates by (cluster, source) combine map-side and spread a frequent cluster over many
    tasks; a second level merges one row a source.
    """
    first = F.struct("norm", "question", "topic", "company", "business", "platform")
    level = F.struct(confidence_rank(F.col("confidence")).alias("rank"), F.col("seq"), F.col("confidence"))
    per = rows.groupBy("cluster", "source_id").agg(
        F.min("seq").alias("seq"),
        F.min_by(first, "seq").alias("first"),
        F.min_by("source", "seq").alias("source"),
        F.min(level).alias("level"),
        *[F.collect_set(F.when(F.col(c) != "", F.col(c))).alias(a) for c, a in ARRAYS.items()],
    )
    whole = per.groupBy("cluster").agg(
        F.min("seq").alias("seq"),
        F.min_by("first", "seq").alias("f"),
        F.min("level")["confidence"].alias("confidence"),
        F.count("*").alias("frequency"),
        F.bool_and(~F.coalesce(F.col("source.is_complete"), F.lit(True))).alias("all_incomplete"),
        F.array_sort(F.collect_list(F.struct("seq", "source_id", "source"))).alias("sources"),
        *[F.flatten(F.collect_set(a)).alias(a) for a in ARRAYS.values()],
    )
    arrays = [F.array_sort(F.array_union(F.col(a), F.array(F.col(f"f.{c}")))).alias(a) for c, a in ARRAYS.items()]
    return whole.select(
        short_id("f.norm").alias("question_id"),
        F.col("f.question").alias("question"),
        F.col("f.norm").alias("normalized"),
        F.col("f.topic").alias("topic"),
        "frequency",
        F.col("frequency").alias("independent_source_count"),
        "confidence",
        quality_score(F.col("confidence"), F.col("frequency"), F.col("all_incomplete")).alias("quality_score"),
        *arrays,
        *[F.col(f"f.{c}").alias(c) for c in ARRAYS],
        "sources",
        "seq",
    )


def in_order(found: DataFrame) -> DataFrame:
    """Questions by falling frequency, then topic, question and sequence."""
    return found.orderBy(F.col("frequency").desc(), "topic", "question", "seq")


def links(found: DataFrame) -> DataFrame:
    """question_sources rows: one for each question and kept source."""
    s = found.select("question_id", F.explode("sources").alias("s"))
    return s.select("question_id", F.col("s.source_id").alias("source_id"), F.col("s.source.evidence.type").alias("evidence_type"), F.col("s.source.evidence.page").alias("evidence_page"), F.col("s.source.evidence.line").alias("evidence_line"), F.coalesce("s.source.evidence.excerpt", F.lit("")).alias("evidence_excerpt"))


def sources_of(found: DataFrame, linked: DataFrame, posts: DataFrame) -> DataFrame:
    """Every question with its sources' title, url, platform and excerpt; one row with nulls where it has none."""
    shown = linked.join(posts.select("source_id", "title", "url", "platform"), "source_id")
    return found.select("question_id").join(shown.select("question_id", "source_id", "title", "url", "platform", "evidence_excerpt"), "question_id", "left")
