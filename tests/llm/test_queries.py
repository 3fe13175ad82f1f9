"""The registered queries on a small folder of tables: columns, types, held-out rows, long texts, and SQL where there is some."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import WORD
from test_classifiers import texts
from test_passages import brute as passages_of

from lodestone.llm import common, merkle, passages, pieces, queries, toxicity, words

COLUMNS = {
    "op1_document_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op2_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op3_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_kneser_ney_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5_exact_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op6_mixing_weights": "doc_id bigint, rate double, copies bigint",
    "op7_sentencepiece": "doc_id bigint, n_tokens bigint, n_chunks bigint, ids_sha256 string, round_trip boolean",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
}
HELD = {"op3_quality_classifier": (5, 0), "op4_kneser_ney_scoring": (7, 2), "op8_toxicity": (5, 0), "op10_language_id": (3, 1)}


def rows():
    rng = random.Random(11)
    out = [(r[0], r[1], r[2]) for r in texts(n=70)]
    shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(60))
    # past every buffer that cuts texts: 3 MB of words, and one without a space
    out += [(100, " ".join(rng.choices(["the", "ing", "ther", "Öl"], k=700_000)) + " " + shared, "aa"), (101, shared + " end", "bb"), (102, "x" * 150_000, "aa")]
    return out + [(103, None, "aa"), (104, "", None), (105, out[0][1], "aa"), (None, out[1][1], "bb")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, lang, "src", len(t or ""), "clash") for i, t, lang in rows()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], r[3], r[4]) for r in texts(n=70)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    rng = np.random.default_rng(5)
    spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(120)], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c, _ in (x.split() for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    got = df.collect()
    if name == "op5_exact_topk":
        assert len(got) == 3 * 5
    else:
        assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows())
    if name in HELD:
        mod, k = HELD[name]
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % mod == k) for r in got)
    by = {r.doc_id: r for r in got} if name != "op5_exact_topk" else {}
    text = {i: t or "" for i, t, _ in rows()}
    if name == "op9_substring_dedup":
        assert sorted((tuple(r) for r in got), key=str) == passages_of([(i, t) for i, t, _ in rows()])
    if name == "op7_sentencepiece":
        lib = pieces.Pieces(pieces.MODEL).lib
        assert by[100].n_chunks > 100 and by[100].n_tokens == len(lib.encode(text[100])) and by[102].round_trip
    if name == "op1_document_fingerprints":
        assert by[102].n_chars == 150_000 and by[102].fingerprint == merkle.fingerprint(text[102])
    if name == "op3_quality_classifier":
        assert all(r.predicted == int(r.score >= 0.3) for r in got)
    if name == "op8_toxicity":
        assert all(r.predicted == int(r.score >= 0.5) for r in got)
    if name == "op10_language_id":
        assert by[103].lang_pred == by[104].lang_pred == "und" and by[100].lang_pred == "aa"
    if name in queries.SQL and name != "op9_substring_dedup":  # held against brute force above
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        cursor = con.execute(queries.SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        flat = lambda r, of: str([round(of(c), 4) if isinstance(of(c), float) else of(c) for c in sorted(names)])
        assert Counter(flat(r, lambda c, r=r: r[c]) for r in got) == Counter(flat(r, lambda c, r=r: r[names.index(c)]) for r in cursor.fetchall())


def test_words_of_texts_past_the_buffers():
    rng = random.Random(4)
    long = [" ".join(rng.choices(["a", "bc", "Öl", "  ", "\n"], k=700_000)), "x" * 1_200_000, "é " * 5]
    data = "".join(long).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in long])))
    start, end, h, pointer = words.split_words(np.frombuffer(data, np.uint8), offsets)
    found = [data[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
    every = [w for t in long for w in WORD.findall(t)]
    assert found == every and np.diff(pointer).tolist() == [len(WORD.findall(t)) for t in long]
    assert len(set(h.tolist())) == len(set(every))
    assert sum(a.nbytes for pair in words._tables for a in pair) <= 17 << 19  # long words leave no long tables behind


def test_runs_of_long_texts_hash_as_alone():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, words.CHUNK + 5000).astype(np.uint64)
    whole = passages.run_hashes(x, 50)
    for at in (0, 17, words.CHUNK - 60, words.CHUNK - 50, words.CHUNK + 3):
        assert whole[at] == passages.run_hashes(x[at : at + 50], 50)[0]


def test_shards_follow_the_size_of_the_input(spark, folder):
    docs = common.read(spark, folder, "documents")
    assert common.shards_for(docs) == common.shuffle_partitions(spark)
    assert common.shards_for(docs, 1 << 14) > common.shuffle_partitions(spark)


def test_arrow_batches_are_bounded(spark, folder):
    common.read(spark, folder, "documents")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= common.BATCH


def test_toxic_word_at_the_end_of_a_long_text_counts():
    model = toxicity.Model(np.zeros(toxicity.ROWS), 0.0, (1.0, 0.0, 0.0))
    data = np.frombuffer(b"grumph", np.uint8)
    _, row, _ = toxicity.word_rows(data, np.array([0]), np.array([6]), words.split_words(data, np.array([0, 6]), space=toxicity.BREAKS)[2])
    model.row_margin[row] = 50.0
    import pyarrow as pa

    long = "the and " * 400_000
    low, high = model.score(pa.array([long, long + "grumph"]))
    assert high > low + 0.4
