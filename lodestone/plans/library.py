"""The rebuild: posts to enriched posts, candidate rows, clusters, questions and links. One lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.text import haystack, normalize_question
from ..operators import aggregate, cluster, extract, identity
from ..operators.keep import keep
from ..operators.search import hybrid_search
from ..rules import DEFAULT, RulePack


@dataclass
class Library:
    """Tables of a library. ``questions`` has nested sources; ``links`` are its question_sources."""

    posts: DataFrame
    rows: DataFrame
    questions: DataFrame

    @property
    def links(self) -> DataFrame:
        return aggregate.links(self.questions)


def candidate_rows(posts: DataFrame, pack: RulePack = DEFAULT, entities: bool = True) -> DataFrame:
    """Rows to cluster: one for each candidate of (source_id, ordinal, post columns), with norm and seq."""
    named = posts.withColumn("_company", F.when(F.col("company") != pack.unknown, F.col("company")).otherwise(C.infer_company("title", "text", pack)))
    keep = ["source_id", "ordinal", "title", "url", "date", "company", "_company", "business", "platform", "confidence", "is_complete", "collection_depth", "text"]
    found = extract.candidates(named.select(*keep), pack, entities=entities)
    own = C.infer_business("question", F.lit(""), pack)
    rank, ordinal = (F.col("ordinal.source_rank"), F.col("ordinal.ordinal")) if "struct" in dict(posts.dtypes)["ordinal"] else (F.lit(0), F.col("ordinal"))
    source = F.struct("source_id", "title", "url", "date", "company", "platform", "confidence", "is_complete", "collection_depth", "evidence")
    out = found.select(
        "question",
        normalize_question("question", pack).alias("norm"),
        C.topic_of("question", pack).alias("topic"),
        F.col("_company").alias("company"),
        F.when(own == pack.unknown, F.col("business")).otherwise(own).alias("business"),
        "platform",
        "confidence",
        "source_id",
        source.alias("source"),
        cluster.sequence(rank, ordinal, F.col("evidence.line")).alias("seq"),
    )
    return out.where(F.length("norm") > 0)


def clustered(rows: DataFrame, threshold: float | None = 0.84, pack: RulePack = DEFAULT) -> DataFrame:
    """Candidate rows with their cluster; equal forms are collapsed before any pair is looked at.

    Without a threshold the form itself is the cluster, and no join is needed.
    """
    if threshold is None:
        return rows.withColumn("cluster", F.col("norm"))
    rows = keep(rows)
    return rows.join(cluster.cluster_forms(rows.select("norm", "seq"), threshold, pack.block), "norm")


def build(posts: DataFrame, pack: RulePack = DEFAULT, threshold: float | None = 0.84, images: DataFrame | None = None, entities: bool = True) -> Library:
    """A library of raw posts (POST columns and ordinal)."""
    unique = identity.latest(identity.enrich(posts, pack, images), pack=pack)
    rows = candidate_rows(unique, pack, entities)
    return Library(unique, rows, aggregate.questions(clustered(rows, threshold, pack)))


def final_order() -> list:
    """Sort keys of a library's questions: falling frequency, topic, question, then sequence."""
    return [(-F.col("frequency")).alias("f"), F.col("topic"), F.col("question"), F.col("seq")]


def searchable(questions: DataFrame) -> DataFrame:
    """Questions as search documents: ordinal (their final order), haystack, quality.

    A saved library has dense ordinals; without them the sort keys themselves serve, as only order matters.
    """
    if "ordinal" not in questions.columns:
        questions = questions.withColumn("ordinal", F.struct(*final_order()))
    return questions.withColumn("haystack", haystack("question", "topic", "companies", "businesses"))


def search_library(library: Library, queries: DataFrame, **options) -> DataFrame:
    """Hybrid search over a library, with the questions' columns and their sources' title, url, platform, excerpt."""
    docs = searchable(library.questions)
    hits = hybrid_search(docs, queries, **options)
    source = lambda s: F.struct(
        s["source"]["title"].alias("title"), s["source"]["url"].alias("url"), s["source"]["platform"].alias("platform"), F.coalesce(s["source"]["evidence"]["excerpt"], F.lit("")).alias("evidence_excerpt")
    )
    shown = docs.select("ordinal", "question_id", "question", "topic", "frequency", "confidence", "quality_score", "companies", "platforms", "businesses", F.transform("sources", source).alias("sources"))
    return hits.join(shown.drop("score"), "ordinal").orderBy("query_id", "place")
