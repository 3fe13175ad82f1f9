"""Dashboard queries over posts and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stats(posts: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: questions, posts, platforms, A-level posts."""
    p = posts.agg(F.count("*").alias("posts"), F.countDistinct(F.when(F.col("platform") != "", F.col("platform"))).alias("platforms"), F.count_if(F.col("confidence") == "A").alias("high"))
    return questions.agg(F.count("*").alias("questions")).join(p)


def filter_options(questions: DataFrame) -> DataFrame:
    """(field, value): distinct non-empty companies, topics and platforms."""
    parts = [questions.select(F.lit(name).alias("field"), value.alias("value")) for name, value in (("company", F.explode("companies")), ("topic", F.col("topic")), ("platform", F.explode("platforms")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("value <> ''").distinct()


def option_order(value, locale: str = "zh"):
    """Sort key of an option: the reading order of a language (in Chinese by pronunciation)."""
    return F.collate(value, locale)


def option_lists(questions: DataFrame, locale: str = "zh") -> DataFrame:
    """(field, place, value): the option lists in their reading order. Distinct options are few."""
    order = Window.partitionBy("field").orderBy(option_order(F.col("value"), locale), "value")
    return filter_options(questions).select("field", F.row_number().over(order).alias("place"), "value")


def filter_questions(questions: DataFrame, *, company: str = "", topic: str = "", platform: str = "", quality: str = "", text: str = "") -> DataFrame:
    """Questions by company, topic, platform, quality ('high': score from .7; else two sources) and text of the row."""
    out = questions
    if company:
        out = out.where(F.array_contains("companies", company))
    if topic:
        out = out.where(F.col("topic") == topic)
    if platform:
        out = out.where(F.array_contains("platforms", platform))
    if quality:
        out = out.where(F.col("quality_score") >= 0.7 if quality == "high" else F.col("independent_source_count") >= 2)
    if text.strip():
        out = out.where(F.lower(F.to_json(F.struct(*questions.columns))).contains(text.strip().lower()))
    return out


def filter_posts(posts: DataFrame, *, company: str = "", platform: str = "", text: str = "") -> DataFrame:
    out = posts
    if company:
        out = out.where(F.col("company") == company)
    if platform:
        out = out.where(F.col("platform") == platform)
    if text.strip():
        out = out.where(F.lower(F.to_json(F.struct(*posts.columns))).contains(text.strip().lower()))
    return out


def question_cards(questions: DataFrame) -> DataFrame:
    """Four companies, topic, quality in percent, badge from two sources on, three sources with their place."""
    place = lambda e: F.when((e["type"] == "ocr") & e["page"].isNotNull(), F.concat(F.lit(" · 图片第 "), e["page"].cast("string"), F.lit(" 页"))).when(
        e["line"].isNotNull(), F.concat(F.lit(" · 正文第 "), e["line"].cast("string"), F.lit(" 行"))
    ).otherwise("")
    link = lambda s: F.concat(s["source"]["title"], place(s["source"]["evidence"]))
    return questions.select(
        "question_id",
        "question",
        F.slice("companies", 1, 4).alias("companies"),
        "topic",
        "confidence",
        F.round(F.col("quality_score") * 100).cast("int").alias("quality"),
        F.when(F.col("frequency") > 1, F.concat(F.col("frequency").cast("string"), F.lit(" 个独立来源"))).otherwise("").alias("badge"),
        F.transform(F.slice("sources", 1, 3), link).alias("links"),
        F.array_join("platforms", " / ").alias("platforms"),
    )


def post_cards(posts: DataFrame) -> DataFrame:
    return posts.select(
        "url",
        "title",
        "company",
        "business",
        "confidence",
        _state().alias("state"),
        "platform",
        F.when(F.col("date") == "", "日期未记录").otherwise(F.col("date")).alias("date"),
    )


def _state():
    depth = F.when(F.coalesce("collection_depth", F.lit("")) == "", "text").otherwise(F.col("collection_depth"))
    return F.concat(depth, F.lit(" · "), F.when(F.col("is_complete"), "完整").otherwise("部分"))
