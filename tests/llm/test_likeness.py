import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
from helpers import WORD, lower, sample
from test_simhash import classes, reference

from lodestone.llm import likeness
from lodestone.llm.common import text_slices

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def near_copies(seed=5):
    """Texts of 40 to 150 words, and copies with one to six words changed, added or cut."""
    rng, rows = random.Random(seed), []
    for k in range(25):
        base = [f"v{rng.randrange(900)}" for _ in range(rng.randint(40, 150))]
        rows.append((10 * k, " ".join(base)))
        for c in range(1, 5):
            text = list(base)
            for _ in range(rng.randint(1, 3)):
                text[rng.randrange(len(text))] = f"n{rng.randrange(99)}"
            rows.append((10 * k + c, " ".join(text[rng.randint(0, 2) :])))
    return rows + [(1000, "a b"), (1001, "A  b"), (1002, "a"), (1003, None), (1004, "")]


def expected(rows):
    """Smallest ids of the classes over both kinds of links."""
    sets, fps = [shingles(t) for _, t in rows], [reference(t) for _, t in rows]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) or (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = top[i], top[j]
                top = [b if x == a else x for x in top]
    least = {}
    for (i, _), t in zip(rows, top):
        least[t] = min(least.get(t, i), i)
    return sorted(least.values())


def test_sets_equal_brute_force():
    texts = [t for _, t in near_copies() + sample() if t is not None]
    for _, _, data, offsets in text_slices(pa.array(texts)):
        h, pointer = likeness.shingle_sets(data, offsets)
        assert np.diff(pointer).tolist() == [len(shingles(t)) for t in texts]


def test_stage_finds_near_copies_of_five_word_shingles(spark, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in rows], SCHEMA)
    want = expected(rows)
    # op2's two bits alone leave many of them
    assert len(want) < len(set(classes([reference(t) for _, t in rows]).values())) - 10
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
    # components dealt to several tiles give the same
    whole = likeness.links
    monkeypatch.setattr(likeness, "links", lambda rows, least: whole(rows, least, chunk=2))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


def test_one_doc_id_on_texts_of_two_classes(spark):
    rng = random.Random(2)
    a, b, c = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(80)) for x in "abc")
    # id 1 stands on two texts of two classes, id 3 on a copy of a smaller id's text and on one of its own
    rows = [(1, a), (1, b), (2, b), (3, a), (3, c), (None, c)]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], SCHEMA)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, a), (1, b), (3, c)])
