"""Every query of the engine's own operators, over whole tables. ``catalog_sql`` states the same in plain SQL.

Queries over ``documents`` use the LATIN test pack; its words stand for no meaning, the rules are those of any pack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_sources
from .catalog_sql import SQL
from .functions import classify as C
from .functions import text as T
from .operators import aggregate, cluster, extract, identity, report, search, state
from .operators.keep import work_path
from .plans import library as plan
from .rules import LATIN
from .sources import html, readers
from .sources.adapters import conversation_posts, document_posts, run_events, table
from .streaming.rebuild import live_status


def _posts(spark, sf_dir):
    """documents as the best version of each identity, enriched."""
    return identity.latest(identity.enrich(document_posts(spark, sf_dir), LATIN), pack=LATIN)


def _rows(spark, sf_dir):
    return plan.candidate_rows(_posts(spark, sf_dir), LATIN)


def _exact(spark, sf_dir):
    return aggregate.questions(plan.clustered(_rows(spark, sf_dir), None, LATIN))


def post_scan(spark, sf_dir):
    return document_posts(spark, sf_dir).select("ordinal", "platform", "title", "url", "business", "confidence", "is_complete")


def post_identity(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("web").alias("platform"), "url", F.lit("t").alias("title"))
    key = C.post_identity("platform", "url", "title", LATIN)
    return pages.select("page_id", key.alias("identity"), C.short_id(key).alias("source_id"))


def _page_versions(spark, sf_dir):
    rows = html.page_posts(table(spark, sf_dir, "pages"), LATIN, nested=False)
    zero = {c: F.lit(0) for c in ("ocr_page_count", "downloaded_image_count")}
    return rows.withColumns(zero | {"collected_at": F.lit("")})


def post_latest(spark, sf_dir):
    best = identity.latest(_page_versions(spark, sf_dir), pack=LATIN)
    return best.select("identity", "source_id", "url", "ordinal", F.length("text").alias("n_text"))


def url_profile(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host = C.url_netloc("url")
    return pages.select("page_id", C.profile_key("url", LATIN).alias("profile"), C.platform_label(host, LATIN).alias("label"), C.note_id("url").alias("note_id"))


def urls_by_profile(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ordinal"), "url")
    return state.groups_by_profile(pages, C.profile_key("url", LATIN)).select("profile", F.size("urls").cast("long").alias("n_urls"), F.get("urls", F.lit(0)).alias("first_url"), F.sha1(F.array_join("urls", "\n")).alias("urls_sha1"))


def html_main_text(spark, sf_dir):
    return html.page_posts(table(spark, sf_dir, "pages"), LATIN, nested=False).select(F.col("ordinal").alias("page_id"), "platform", "title", "text")


def html_nested_text(spark, sf_dir):
    return html.page_posts(table(spark, sf_dir, "pages"), LATIN).select(F.col("ordinal").alias("page_id"), "text")


def blocked_pages(spark, sf_dir):
    return html.rejected(html.page_posts(table(spark, sf_dir, "pages"), LATIN, nested=False)).select(F.col("ordinal").alias("page_id"), "host", "reason")


def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text("text").alias("text"))


def normalize_question(spark, sf_dir):
    return extract.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), LATIN).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "norm")


def inline_split(spark, sf_dir):
    whole = T.inline_split(T.clean_text("text"), LATIN)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.split_lines(whole)).cast("long").alias("n_lines"), F.sha1(whole).alias("text_sha1"))


def candidates(spark, sf_dir):
    found = extract.candidates(table(spark, sf_dir, "documents").select("doc_id", "text"), LATIN)
    return found.select("doc_id", "question", F.col("evidence.type").alias("evidence_type"), F.col("evidence.line").cast("long").alias("evidence_line"), F.col("evidence.excerpt").alias("evidence_excerpt"))


def ocr_pages(spark, sf_dir):
    rows = extract.lines(conversation_posts(spark, sf_dir), LATIN).where(~F.col("is_marker"))
    return rows.select(F.col("ordinal").alias("conv_id"), F.col("line_no").cast("long").alias("line_no"), F.col("page").cast("long").alias("page"), "line")


def topic_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.topic_of("text", LATIN).alias("topic"))


def infer_fields(spark, sf_dir):
    posts = document_posts(spark, sf_dir)
    return posts.select("ordinal", C.infer_company("title", "text", LATIN).alias("company"), C.infer_business("title", "text", LATIN).alias("business"), C.infer_date("text").alias("date"))


def question_frequency(spark, sf_dir):
    """Distinct normalised lines of 5 to 130 characters by number of documents."""
    rows = extract.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), LATIN).select("doc_id", F.col("norm").alias("normalized"))
    counted = rows.where(F.length("normalized").between(LATIN.shortest, LATIN.longest)).groupBy("normalized").agg(F.countDistinct("doc_id").alias("frequency"))
    return counted.select("normalized", "frequency", C.short_id("normalized").alias("question_id"))


def cluster_exact(spark, sf_dir):
    q = _exact(spark, sf_dir)
    return q.select("question_id", "question", "normalized", "topic", "frequency", "independent_source_count", "confidence", "quality_score", *[F.array_join(c, "|").alias(c) for c in ("companies", "platforms", "businesses")])


def question_sources(spark, sf_dir):
    return aggregate.links(_exact(spark, sf_dir)).select("question_id", "source_id", "evidence_type", F.col("evidence_line").cast("long").alias("evidence_line"), "evidence_excerpt")


def question_sources_join(spark, sf_dir):
    """Sources of each question with their post's title, url and platform."""
    links = aggregate.links(_exact(spark, sf_dir))
    posts = _posts(spark, sf_dir).select("source_id", "title", "url", "platform")
    return links.join(posts, "source_id").groupBy("question_id").agg(F.count("*").alias("n_sources"), F.min("url").alias("first_url"), F.max("title").alias("last_title"), F.countDistinct("platform").alias("n_platforms"))


def near_duplicates(spark, sf_dir):
    """(norm, cluster): the representative of every distinct candidate."""
    rows = _rows(spark, sf_dir)
    forms = cluster.cluster_forms(rows.select("norm", "seq"), 0.84, LATIN.block)
    return forms


def cluster_near(spark, sf_dir):
    q = aggregate.questions(plan.clustered(_rows(spark, sf_dir), 0.84, LATIN))
    return q.select("question_id", "question", "topic", "frequency", "confidence", "quality_score", "companies", "platforms", "businesses")


def terms(spark, sf_dir):
    post = search.postings(_hay(spark, sf_dir), "ordinal", "haystack")
    return post.select(F.col("ordinal").alias("doc_id"), "term", "tf")


def term_vectors(spark, sf_dir):
    post = search.postings(_queries(spark, sf_dir), "query_id", "query")
    return search.vectors(post, "query_id", "md5").select("query_id", "dim", "w")


def term_vectors_blake2b(spark, sf_dir):
    post = search.postings(_queries(spark, sf_dir), "query_id", "query")
    return search.vectors(post, "query_id").select("query_id", "dim", "w")


def _hay(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), "quality")
    quality = F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.52).otherwise(0.72)
    return docs.join(labels, F.col("doc_id") == F.col("_id"), "left").select(F.col("doc_id").alias("ordinal"), F.col("text").alias("haystack"), quality.alias("quality_score"))


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


PATTERN = "license|erung"


def lexical_recall(spark, sf_dir):
    docs, asked = _hay(spark, sf_dir), _queries(spark, sf_dir)
    found = search.lexical(docs, asked, search.postings(docs, "ordinal", "haystack"), search.postings(asked, "query_id", "query"), PATTERN)
    return found.select("query_id", "ordinal", F.round("score", 6).alias("score"))


def regex_recall(spark, sf_dir):
    return _hay(spark, sf_dir).where(C.regex_hit("haystack", PATTERN)).select("ordinal")


def vector_recall(spark, sf_dir):
    docs, asked = _hay(spark, sf_dir), _queries(spark, sf_dir)
    v = lambda t, k, c: search.vectors(search.postings(t, k, c), k, "md5")
    return search.cosine(v(docs, "ordinal", "haystack"), v(asked, "query_id", "query")).select("query_id", "ordinal", F.round("score", 6).alias("score"))


def hybrid_search(spark, sf_dir):
    """The 20 best documents of each query, by lexical and hashed-vector rank."""
    return search.hybrid_search(_hay(spark, sf_dir), _queries(spark, sf_dir), top_k=20, encoder="md5", grep_pattern=PATTERN).select("query_id", "ordinal", "place", "score")


def hybrid_search_blake2b(spark, sf_dir):
    return search.hybrid_search(_hay(spark, sf_dir), _queries(spark, sf_dir), top_k=20)


def dense_recall(spark, sf_dir):
    """The 10 best vectors for the query vectors of ids divisible by 50, by dot product."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    scored = search.dense(v.withColumnRenamed("vec_id", "ordinal"), v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"))
    return search.best(scored, 10).select("query_id", "ordinal", "rank", F.round("score", 6).alias("score"))


def run_items(spark, sf_dir):
    return state.items(run_events(spark, sf_dir))


def run_replay(spark, sf_dir):
    return state.replay(run_events(spark, sf_dir)).select("run_id", "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "completed", "failures")


def run_status(spark, sf_dir):
    return state.newest(state.replay(run_events(spark, sf_dir))).select("run_id", "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "completed", "failures")


def _wanted(spark, sf_dir):
    return run_events(spark, sf_dir).select("run_id", "item").distinct()


def pending_items(spark, sf_dir):
    return state.pending(_wanted(spark, sf_dir), run_events(spark, sf_dir))


def session_done(spark, sf_dir):
    return state.all_done(_wanted(spark, sf_dir), run_events(spark, sf_dir))


def resume_latest(spark, sf_dir):
    """Of each task (here the first digit of a run's id), the newest run that isn't complete."""
    runs = state.replay(run_events(spark, sf_dir)).withColumn("fingerprint", C.task_fingerprint(F.substring(F.col("run_id").cast("string"), 1, 1)))
    runs = runs.withColumn("updated_at", F.concat(F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.lpad(F.col("run_id").cast("string"), 12, "0")))
    return state.resumable(runs).select("fingerprint", "run_id", "status")


def keywords(spark, sf_dir):
    given = table(spark, sf_dir, "nation").select("n_nationkey", readers.keywords(F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" a, b ,a,, "), F.col("n_name")))).alias("k"))
    return given.select("n_nationkey", F.array_join("k", "|").alias("keywords"))


def stats(spark, sf_dir):
    return report.stats(_posts(spark, sf_dir), _exact(spark, sf_dir))


def filter_options(spark, sf_dir):
    return report.filter_options(_exact(spark, sf_dir))


def filter_questions(spark, sf_dir):
    return report.filter_questions(_exact(spark, sf_dir), company="Apache", quality="high", text=" Apache ").select("question_id", "question", "frequency")


def filter_posts(spark, sf_dir):
    return report.filter_posts(_posts(spark, sf_dir), company="Thing", platform="src1").select("source_id", "url")


def question_cards(spark, sf_dir):
    cards = report.question_cards(_exact(spark, sf_dir))
    return cards.select("question_id", "quality", "badge", F.array_join("companies", "|").alias("companies"), F.array_join("links", "|").alias("links"), "platforms")


def post_cards(spark, sf_dir):
    return report.post_cards(_posts(spark, sf_dir)).select("url", "company", "business", "state", "date")


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run counters from events read as a stream, drained once."""
    root = work_path(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kind = F.when(F.col("event_type") == "error", "failed").otherwise("done")
    events = source.where("event_type <> 'purchase'").select(F.col("user_id").alias("run_id"), kind.alias("kind"), "ts")
    put = lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out")
    q = live_status(events).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("run_id", "done_marks", "failed_marks")


_QUERIES = {
    f.__name__: f
    for f in (
        post_scan, post_identity, post_latest, url_profile, urls_by_profile, html_main_text, html_nested_text, blocked_pages, clean_text,
        normalize_question, inline_split, candidates, ocr_pages, topic_of, infer_fields, question_frequency, cluster_exact,
        question_sources, question_sources_join, near_duplicates, cluster_near, terms, term_vectors, term_vectors_blake2b, lexical_recall,
        regex_recall, vector_recall, hybrid_search, hybrid_search_blake2b, dense_recall, run_items, run_replay, run_status, pending_items,
        session_done, resume_latest, keywords, stats, filter_options, filter_questions, filter_posts, question_cards, post_cards, stream_status,
    )
}


def queries():
    return _QUERIES | catalog_sources.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | catalog_sources.SQL
