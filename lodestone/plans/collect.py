"""Collecting from landed snapshots: what a run takes of them, and how its run file says so.

Fetching pages is no part of the engine; a run takes posts that others have landed. Keywords take their first posts that no
library has yet, addresses the post of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators.identity import first_of, without_seen
from ..operators.runs import RunFile
from ..rules import DEFAULT, RulePack

#: fixed values: keys of a run's items
KEYWORD, NOTE, URL, SESSION, NOTES = "xhs:keyword:", "xhs:note:", "web:url:", ":session", "xhs"
NO_SNAPSHOT = "no landed snapshot"


def plain_url(url):
    """An address without its fragment."""
    return F.substring_index(url, "#", 1)


def seen_notes(posts: DataFrame, pack: RulePack = DEFAULT) -> DataFrame:
    """(note) ids of a library's notes, which a run leaves out."""
    own = (F.col("platform") == pack.note_platform) & C.url_path("url").contains("/explore/")
    return posts.where(own).select(C.note_id("url").alias("note")).distinct()


def take_notes(landed: DataFrame, words: DataFrame, seen: DataFrame, most: int, pack: RulePack = DEFAULT) -> DataFrame:
    """Of each keyword of ``words`` (keyword), the ``most`` first landed notes that aren't seen; adds note."""
    notes = landed.where(F.col("platform") == pack.note_platform).join(F.broadcast(words), "keyword").withColumn("note", C.note_id("url"))
    fresh = first_of(without_seen(notes, seen, ["note"]), ["keyword", "note"], [F.col("ordinal")])
    return first_of(fresh, ["keyword"], [F.col("ordinal")], max(1, most))


def take_urls(landed: DataFrame, urls: DataFrame) -> DataFrame:
    """Landed posts of the addresses (url), told without fragments; the first post of each."""
    wanted = urls.select(plain_url("url").alias("_plain")).distinct()
    return first_of(landed.withColumn("_plain", plain_url("url")).join(wanted, "_plain"), ["_plain"], [F.col("ordinal")])


def collect(spark: SparkSession, run: RunFile, landed: DataFrame, library: DataFrame, keywords: list[str], urls: list[str], most: int, pack: RulePack = DEFAULT) -> DataFrame:
    """Posts that the run takes of ``landed``; items done before are left out, and each item is marked.

    The keywords and addresses of one run are a short list, so their marks are gathered.
    """
    words = [k for k in keywords if not run.is_done(KEYWORD + k)]
    rest = [u for u in dict.fromkeys(urls) if not run.is_done(URL + u.split("#", 1)[0])]
    asked = spark.createDataFrame([(k,) for k in words], "keyword string")
    given = spark.createDataFrame([(u, k) for k, u in enumerate(rest)], "url string, at int")
    columns = landed.columns
    notes = take_notes(landed, asked, seen_notes(library, pack), most, pack).select(*columns, "note")
    pages = take_urls(landed, given).select(*columns, "_plain")
    for word in words:
        ids = [r.note for r in notes.where(F.col("keyword") == word).orderBy("ordinal").select("note").collect()]
        known = bool(ids) or bool(landed.where((F.col("platform") == pack.note_platform) & (F.col("keyword") == word)).head(1))
        run.mark([NOTE + i for i in ids] + ([KEYWORD + word] if known else []), {} if known else {KEYWORD + word: NO_SNAPSHOT})
    if keywords and all(run.is_done(KEYWORD + k) for k in keywords):
        run.mark_done(NOTES + SESSION)
    found = {r["_plain"] for r in pages.select("_plain").collect()}
    plain = [u.split("#", 1)[0] for u in rest]
    run.mark([URL + u for u in plain if u in found], {URL + u: NO_SNAPSHOT for u in plain if u not in found})
    groups: dict[str, list[str]] = {}
    for r in spark.createDataFrame([(u,) for u in dict.fromkeys(urls)], "url string").select("url", C.profile_key("url", pack).alias("key")).collect():
        groups.setdefault(r.key, []).append(r.url.split("#", 1)[0])
    run.mark([key + SESSION for key, own in groups.items() if all(run.is_done(URL + u) for u in own)])
    return notes.select(*columns).unionByName(pages.select(*columns))
