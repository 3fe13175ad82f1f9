"""Note pages: body slice, image addresses, nested payloads, search responses, OCR lines."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import _c, clean_text, split_lines, strip
from ..rules import DEFAULT, RulePack

_info = T.ArrayType(T.StructType([T.StructField("url", T.StringType())]))
IMAGE = T.StructType([*(T.StructField(n, T.StringType()) for n in ("url_default", "url_pre", "url")), T.StructField("info_list", _info)])
CARD = T.StructType([T.StructField("image_list", T.ArrayType(IMAGE)), T.StructField("cover", IMAGE)])
#: fixed values: what ends a note's body
STOP, STOP_PATTERN = "猜你想搜", "^共\\s*\\d+\\s*条评论$"
LEAST_BODY, LEAST_DESCRIPTION = 20, 40


def note_text(body, title, description) -> Column:
    """From the last line equal to the title up to a stop line, else a long description, else the body."""
    lines = F.transform(split_lines(F.coalesce(_c(body), F.lit(""))), lambda x: clean_text(x, entities=False))
    title, description = clean_text(title), clean_text(description)
    at = F.size(lines) - F.array_position(F.reverse(lines), title).cast("int") + 1
    rest = F.slice(lines, at, F.size(lines))
    stops = F.filter(F.transform(rest, lambda x, i: F.when((i > 0) & ((x == STOP) | x.rlike(STOP_PATTERN)), i)), lambda i: i.isNotNull())
    main = clean_text(F.array_join(F.slice(rest, F.lit(1), F.coalesce(F.get(stops, F.lit(0)), F.size(rest))), "\n"))
    found = (title != "") & F.array_contains(lines, title)
    fallback = F.when(F.length(description) >= LEAST_DESCRIPTION, description).otherwise(clean_text(body))
    return F.when(found & (F.length(main) >= LEAST_BODY), main).otherwise(fallback)


def _address(image: Column) -> Column:
    every = F.concat(F.array(image["url_default"], image["url_pre"], image["url"]), F.coalesce(F.transform(image["info_list"], lambda x: x["url"]), F.array().cast("array<string>")))
    return F.get(F.filter(every, lambda u: F.coalesce(u.startswith("http"), F.lit(False))), F.lit(0))


def image_urls(card) -> Column:
    """First usable address of each image of a card (struct or JSON string), distinct in order; else the cover's."""
    card = _c(card)
    images = F.coalesce(F.transform(card["image_list"], _address), F.array().cast("array<string>"))
    urls = F.array_distinct(F.filter(images, lambda u: u.isNotNull()))
    cover = F.filter(F.array(_address(card["cover"])), lambda u: u.isNotNull())
    return F.when(F.size(urls) > 0, urls).otherwise(cover)


def parse_card(text) -> Column:
    return F.from_json(_c(text), CARD)


def _addresses(card: dict) -> list[str]:
    def usable(image):
        given = [image.get(k) for k in ("url_default", "url_pre", "url")]
        given += [x.get("url") for x in image.get("info_list") or [] if isinstance(x, dict)]
        return next((u for u in given if isinstance(u, str) and u.startswith("http")), None)

    found = dict.fromkeys(filter(None, (usable(x) for x in card.get("image_list") or [] if isinstance(x, dict))))
    if not found and isinstance(card.get("cover"), dict):
        found = dict.fromkeys(filter(None, [usable(card["cover"])]))
    return list(found)


def _galleries(value, note_id: str):
    """Galleries of a note at any depth, later members before earlier ones."""
    members = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    if isinstance(value, dict) and value.get("image_list") and str(value.get("note_id") or value.get("id") or "") == note_id:
        yield _addresses(value)
    for member in reversed(list(members)):
        yield from _galleries(member, note_id)


def gallery_in(payload, note_id: str) -> list[str]:
    """Longest gallery of a note anywhere in a payload, the first met of equal ones."""
    return max(_galleries(payload, note_id), key=len, default=[])


@F.pandas_udf(T.ArrayType(T.StringType()))
def detail_image_urls(payload: pd.Series, note_id: pd.Series) -> pd.Series:
    def one(text, key):
        try:
            return gallery_in(json.loads(text), key)
        except (TypeError, ValueError):
            return []

    return pd.Series([one(p, k) for p, k in zip(payload, note_id)])


def search_items(responses: DataFrame, payload: str = "payload", order: str = "ordinal") -> DataFrame:
    """(id, xsec_token, note_card): first item of each id that has a token."""
    parsed = responses.select(order, F.from_json(F.col(payload), "data struct<items: array<struct<id: string, xsec_token: string, note_card: string>>>").alias("r"))
    items = parsed.select(order, F.posexplode("r.data.items").alias("at", "item")).where("item.id <> '' AND item.xsec_token <> ''")
    return items.groupBy(F.col("item.id").alias("id")).agg(F.min_by("item", F.struct(order, "at")).alias("i")).select("id", "i.xsec_token", "i.note_card")


def ocr_text(pages, pack: RulePack = DEFAULT, least: float = 0.55) -> Column:
    """Text of recognised pages (array of (page, lines array of (text, score))): confident lines under page markers."""
    head, tail = pack.page_marker
    kept = F.transform(
        _c(pages),
        lambda p: F.struct(p["page"].alias("page"), F.filter(F.transform(F.filter(p["lines"], lambda x: x["score"] >= least), lambda x: strip(x["text"])), lambda x: x != "").alias("lines")),
    )
    blocks = F.transform(F.filter(kept, lambda p: F.size(p["lines"]) > 0), lambda p: F.concat(F.lit(head), p["page"].cast("string"), F.lit(tail + "\n"), F.array_join(p["lines"], "\n")))
    return F.array_join(blocks, "\n")
