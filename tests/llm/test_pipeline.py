import random

import corpus_pipeline
from helpers import WORD
from pyspark.sql import functions as F
from test_classifiers import texts
from test_passages import brute as passages_of
from test_simhash import classes, reference

from lodestone.llm import pieces


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(r[0], r[1], r[2]) for r in texts(n=150)]
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    rows += [(300 + k, rows[k][1], rows[k][2]) for k in range(10)]
    rows += [(400 + k, rows[20 + k][1] + " " + passage, rows[20 + k][2]) for k in range(5)]
    rows += [(500, None, "aa"), (501, "12 34", "aa"), (502, "", None), (503, "12 34", "bb")]
    documents = spark.createDataFrame([(i, t, lang, "src0", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], r[3], r[4]) for r in texts(n=150)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.collect())
    language, near, cut, mixed, tokens = seen
    assert {r.doc_id for r in language} == {i for i, t, _ in rows if t and any(c.isalpha() for c in t)}
    root = classes([reference(r.text) for r in language])
    first = {}
    for r in language:
        k = root[reference(r.text)]
        first[k] = min(first.get(k, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in near) == sorted(first.values())
    expected = {x[0]: x[1] - x[2] for x in passages_of([(r.doc_id, r.text) for r in near])}
    assert {r.doc_id: len(WORD.findall(r.text)) for r in cut} == {i: n for i, n in expected.items() if n}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in cut} and 0 < len(mixed) < len(cut)
    text = {r.doc_id: r.text for r in mixed}
    lib = pieces.Pieces(pieces.MODEL).lib
    assert len(tokens) == len(mixed) and all(r.token_ids == lib.encode(text[r.doc_id]) and r.round_trip for r in tokens)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(r.doc_id for r in tokens)


def test_repeated_rows_nulls_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, "some words here", "aa", "s", 15)] * 3 + [(None, "some words here", "aa", "s", 15), (None, "other and more", "aa", None, None), (2, "und so weiter", "bb", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "None"]
    # without labels every rate is 1: nothing goes, null ids included
    assert sorted(str(r.doc_id) for r in corpus_pipeline.mixture(spark, out, str(tmp_path)).collect()) == ["1", "2", "None"]
    for table in (docs, docs.where(F.lit(False))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            assert stage(spark, table, str(tmp_path)).count() <= table.count()


def test_rows_are_picked_without_a_shuffle(spark, tmp_path):
    from lodestone.llm.hashstore import pick

    spark.range(100, numPartitions=5).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.monotonically_increasing_id().alias("row")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    out = pick(rows, rows.where("doc_id % 7 = 3").repartition(3), "picked")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.select("doc_id", "text").collect())) == [(k, f"t{k}") for k in range(100) if k % 7 == 3]
    assert pick(rows, rows.where("doc_id < 0"), "none").count() == 0
