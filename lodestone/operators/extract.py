"""Candidate questions with the line and page that prove them. Narrow: no shuffle, no Python but entities."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.classify import looks_like_question
from ..rules import DEFAULT, RulePack


def _page_of(line: Column, pack: RulePack) -> Column:
    """Page number of a line that is a page marker, else null."""
    head, tail = (re.escape(x) for x in pack.page_marker)
    number = F.regexp_extract(line, f"^{head}({T.DIGIT}+){tail}$", 1)
    return F.translate(number, "０１２３４５６７８９", "0123456789").try_cast("int")


def lines(posts: DataFrame, pack: RulePack = DEFAULT, text: str = "text", entities: bool = True, labels: bool = False, norms: bool = True) -> DataFrame:
    """All columns but text, with line_no (1-based, blanks and markers count), line, its norm, page and is_marker.

    A page marker holds for the lines after it, up to the next marker of the same post. ``labels`` writes round
    labels in their canonical form first. Lines are cleaned and normalised inside the array, before it is
    exploded: a filter on them then reads a value instead of repeating the expressions. Without ``norms`` there is
    no norm, for a caller that drops most lines by other signs first. The outer explode keeps the optimizer from
    testing the array's size before it, which would make the whole array twice.
    """
    whole = T.inline_split(T.clean_text(text, entities), pack)
    keep = [c for c in posts.columns if c != text]
    raw = posts.select(*keep, F.transform(T.split_lines(whole), T.strip_bullets).alias("_lines"))
    pages = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("at"), _page_of(x, pack).alias("page"))), lambda m: m["page"].isNotNull())
    marks = F.when(F.exists("_lines", lambda x: x.contains(pack.page_marker[0])), pages)
    shown = F.transform("_lines", lambda x: T.round_label(x, pack)) if labels else F.col("_lines")
    both = F.transform(shown, lambda x: F.struct(x.alias("line"), *[T.normalize_question(x, pack).alias("norm")] * norms))
    # marks belong to the post: beside the explode they would be looked for once a line, over all its lines
    found = raw.select(*keep, marks.alias("_marks"), both.alias("_both"))
    rows = found.select(*keep, "_marks", F.posexplode_outer("_both").alias("_at", "_x")).where(F.col("_at").isNotNull())
    before = F.filter("_marks", lambda m: m["at"] < F.col("_at"))
    return rows.select(
        *keep,
        (F.col("_at") + 1).alias("line_no"),
        F.col("_x.line").alias("line"),
        *[F.col("_x.norm").alias("norm")] * norms,
        F.when(F.col("_marks").isNotNull(), F.element_at(F.when(F.size(before) > 0, before), -1)["page"]).alias("page"),
        F.coalesce(F.exists("_marks", lambda m: m["at"] == F.col("_at")), F.lit(False)).alias("is_marker"),
    )


def candidates(posts: DataFrame, pack: RulePack = DEFAULT, text: str = "text", entities: bool = True) -> DataFrame:
    """Questions of each post: its columns but text, question, and evidence (type, page, line, excerpt)."""
    keep = [c for c in posts.columns if c not in (text, "norm", "line", "page", "line_no", "is_marker")]
    rows = lines(posts.select(*keep, text), pack, text, entities, labels=True, norms=False).where(~F.col("is_marker"))
    rows = rows.where(looks_like_question("line", pack))
    evidence = F.struct(
        F.when(F.col("page").isNotNull(), "ocr").otherwise("text").alias("type"),
        F.col("page"),
        F.col("line_no").alias("line"),
        F.substring("line", 1, 240).alias("excerpt"),
    )
    return rows.select(*keep, F.substring(T.drop_numbering("line", pack), 1, 180).alias("question"), evidence.alias("evidence"))
