"""The registered queries of subpackage llm: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fingerprint_with_next

    return fingerprint_with_next(read(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_of, near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_texts

    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)))
    docs = docs.withColumn("learn", ~F.col("held_out"))
    return score_texts(docs, read(spark, sf_dir, "labels"), "learn", ["doc_id", "held_out"])


def op4_kneser_ney_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser import Model, score_texts

    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)))
    scored = score_texts(docs, Model(docs, ~F.col("held_out")), ["doc_id", "held_out"])
    # sums of logarithms differ in their last bits with the order of summing
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score", "perplexity")})


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantize, search

    return search(quantize(read(spark, sf_dir, "embeddings")))


def op6_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("u")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    return encode(read(spark, sf_dir, "documents"), ["doc_id"], ("n_tokens", "n_chunks", "ids_sha256", "round_trip"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_texts, train

    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)))
    return score_texts(docs, train(docs, read(spark, sf_dir, "labels"), ~F.col("held_out")), ["doc_id", "held_out"])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import locate

    return locate(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict

    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)))
    return predict(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_kneser_ney_scoring": op4_kneser_ney_scoring,
    "op5_exact_topk": op5_exact_topk,
    "op6_mixing_weights": op6_mixing_weights,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
    "pipeline": pipeline,
}

_BITS = "list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
#: crc32 of doc_id as text: byte by byte, then bit by bit, from the polynomial
_CRC = f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda s: CAST(ord(s) AS BIGINT))), lambda c, b: {_BITS}))"""
_WORDS = r"'[^\x20\x09-\x0D]+'"


def _cut(n: str, d: str) -> str:
    """What the discounts of row ``d`` take from the count ``n``."""
    return f"CASE WHEN {n} = 1 THEN {d}.d1 WHEN {n} = 2 THEN {d}.d2 WHEN {n} > 2 THEN {d}.d3 ELSE 0.0::DOUBLE END"


def _discounts(table: str, n: str) -> str:
    within = lambda x, k: f"least(greatest({x}, 0.05::DOUBLE), {k} - 0.05::DOUBLE)"
    d1, d2, d3 = within("1 - 2 * y * n2 / n1", 1), within("2 - 3 * y * n3 / n2", 2), within("CASE WHEN n3 > 0 THEN 3 - 4 * y * n4 / n3 ELSE 1.5::DOUBLE END", 3)
    either = "CASE WHEN n1 = 0 THEN 0.5::DOUBLE WHEN n2 = 0 THEN 0.75::DOUBLE ELSE {} END"
    counts = ", ".join(f"count(*) FILTER ({n} = {k})::DOUBLE AS n{k}" for k in (1, 2, 3, 4))
    return f"SELECT {either.format(d1)} AS d1, {either.format(d2)} AS d2, {either.format(d3)} AS d3 FROM (SELECT *, n1 / (n1 + 2 * n2) AS y FROM (SELECT {counts} FROM {table}))"


SQL = {
    "op4_kneser_ney_scoring": f"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce({_CRC} % 7 = 2, false) AS held_out,
                list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}), chr(10)) AS ws FROM documents
        ), a AS (SELECT r, held_out, unnest(list_prepend(chr(9), ws[1:len(ws) - 1])) AS c, unnest(ws) AS w FROM d),
        u AS (SELECT w, count(*) AS n FROM a WHERE NOT held_out GROUP BY w),
        p AS (SELECT c, w, count(*) AS n FROM a WHERE NOT held_out GROUP BY c, w),
        m AS (SELECT w, count(*) AS n FROM p GROUP BY w),
        dp AS ({_discounts("p", "n")}), dm AS ({_discounts("m", "n")}),
        x AS (SELECT c, sum(n) AS every, sum({_cut("n", "dp")}) AS free FROM p, dp GROUP BY c),
        t AS (SELECT (SELECT sum(n) FROM u)::BIGINT AS N, (SELECT count(*) FROM u) AS V, (SELECT count(*) FROM p) AS M, (SELECT sum({_cut("n", "dm")}) FROM m, dm) AS h),
        s AS (
            SELECT r, u.n AS known, t.N, log10((coalesce(u.n, 0) + 1)::DOUBLE / (t.N + t.V + 1)) AS base,
                (coalesce(m.n, 0) - {_cut("coalesce(m.n, 0)", "dm")}) / t.M + t.h / t.M / (t.V + 1) AS q,
                (coalesce(p.n, 0) - {_cut("coalesce(p.n, 0)", "dp")}) / x.every AS top, x.free / x.every AS g
            FROM a CROSS JOIN t CROSS JOIN dp CROSS JOIN dm LEFT JOIN u ON a.w = u.w LEFT JOIN m ON a.w = m.w LEFT JOIN p ON a.c = p.c AND a.w = p.w LEFT JOIN x ON a.c = x.c
        ), e AS (SELECT r, count(*) AS n_tokens, count(known) AS n_known, any_value(N) AS train_tokens, sum(base) AS b, sum(log10(coalesce(top + g * q, q))) AS l FROM s GROUP BY r)
        SELECT doc_id, held_out, n_tokens, n_known, train_tokens, round(b, 6) AS base_score, round(l, 6) AS score, round(pow(10, -l / n_tokens), 6) AS perplexity FROM d JOIN e USING (r)
    """,
    "op9_substring_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
        p AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d WHERE doc_id IS NOT NULL),
        v AS (SELECT r, doc_id, i, md5(t) AS h FROM (SELECT r, doc_id, i, string_agg(word, ' ') OVER o AS t, count(*) OVER o AS n FROM p WINDOW o AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) WHERE n = 50),
        f AS (SELECT h, min(doc_id) AS first FROM v GROUP BY h),
        g AS (SELECT DISTINCT r, i + k AS i FROM (SELECT r, i FROM v JOIN f USING (h) WHERE first < doc_id), range(50) AS t(k)),
        x AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        k AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM x ANTI JOIN g USING (r, i) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
    """,
    "op5_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}


def queries():
    return QUERIES


def oracle_sql():
    return SQL
