"""Enrichment of posts and the best version of each identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.text import count_page_markers
from ..rules import DEFAULT, RulePack


def enrich(posts: DataFrame, pack: RulePack = DEFAULT, images: DataFrame | None = None) -> DataFrame:
    """Company when inferred, business and date where missing, page counters of notes with page markers.

    ``images`` (note_id, downloaded) counts landed images of a note.
    """
    company, business = C.infer_company("title", "text", pack), C.infer_business("title", "text", pack)
    pages = count_page_markers("text", pack)
    deep = (F.col("platform") == pack.note_platform) & (pages > 0)
    out = posts
    if images is not None:
        out = out.withColumn("_note", C.note_id("url")).join(images.select(F.col("note_id").alias("_note"), F.col("downloaded").alias("_images")), "_note", "left").drop("_note")
    else:
        out = out.withColumn("_images", F.lit(0))
    return out.withColumns(
        {
            "company": F.when(company != pack.unknown_company, company).otherwise(F.col("company")),
            "business": F.when((business != pack.unknown) & F.col("business").isin(pack.unknown, ""), business).otherwise(F.col("business")),
            "date": F.when(F.col("date") == "", C.infer_date("text")).otherwise(F.col("date")),
            "collection_depth": F.when(deep, "deep").otherwise(F.col("collection_depth")),
            "ocr_page_count": F.when(deep, pages).otherwise(F.col("ocr_page_count")),
            "downloaded_image_count": F.when(deep, F.greatest("downloaded_image_count", F.coalesce("_images", F.lit(0)))).otherwise(F.col("downloaded_image_count")),
            "is_complete": F.when(deep & (F.col("expected_image_count") == 0), False).otherwise(F.col("is_complete")),
        }
    ).drop("_images")


#: what makes a version better, in order
VERSION_KEYS = ("ocr_page_count", "downloaded_image_count", "collected_at")


def _reversed(column: str) -> list:
    """Keys whose ascending order is the descending order of a string: complemented UTF-8 bytes, longer first."""
    flipped = F.translate(F.hex(F.encode(F.col(column), "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210")
    return [F.concat(flipped, F.lit("G"))]


def latest(posts: DataFrame, ordinal: str = "ordinal", pack: RulePack = DEFAULT) -> DataFrame:
    """The best version of each identity: longest text, most pages, most images, newest; the earliest on ties.

    ``ordinal`` of the result is the identity's first appearance; ``source_id`` is added. One aggregation:
    struct maximum is combined map-side, so a hot identity moves one row a task.
    """
    key = C.post_identity("platform", "url", "title", pack)
    # smallest after negating what should be large, so that the earliest of equal versions wins for any ordinal
    worse = F.struct(-F.length("text"), *[-F.col(c) for c in VERSION_KEYS[:2]], *_reversed(VERSION_KEYS[2]), F.col(ordinal))
    best = F.min_by(F.struct(*posts.columns), worse)
    picked = posts.withColumn("identity", key).groupBy("identity").agg(best.alias("p"), F.min(ordinal).alias("first"))
    return picked.select("identity", C.short_id("identity").alias("source_id"), *[F.col(f"p.{c}") for c in posts.columns if c != ordinal], F.col("first").alias(ordinal))


def first_of(rows: DataFrame, key: list[str], order: list, most: int = 1) -> DataFrame:
    """The ``most`` first rows of each key in the given order; with 1 a first-wins upsert.

    The limit is pushed below the shuffle, so a hot key moves ``most`` rows a task.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def without_seen(rows: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key was not seen or done before."""
    return rows.join(seen.select(*key), key, "left_anti")
