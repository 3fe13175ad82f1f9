import os

import pytest
from helpers import documents, sample
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no public tokenizer here")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "e", "th", "the", " ", "  ", "é", "\n", "漢", "😀", "12", "▁", "xxxxx", " " * 20, "ing"]), max_size=60).map("".join), st.sampled_from([32, 48, 100]))
def test_scan_gives_the_library_ids(text, size):
    p = pieces.Pieces(pieces.MODEL)
    ids = pieces.encode_giant(text, p, size)
    assert ids == p.lib.encode(text)
    assert p.lib.decode(ids) == text.replace("▁", " ")


def test_spark_equals_library(spark):
    rows = [*sample(), (600, "nospace" * 900), (601, "ab  cd\n" * 700), (602, " " * 5000)]
    docs = documents(spark, rows)
    lib = pieces.Pieces(pieces.MODEL).lib
    got = pieces.encode(docs, giant=300, size=128).collect()
    assert len(got) == len(rows)
    assert any((r.n_chunks or 0) > 10 for r in got)
    for r in got:
        assert r.token_ids == (None if r.text is None else lib.encode(r.text))
    again = pieces.decode(pieces.encode(docs, giant=300, size=128)).collect()
    assert all(r.decoded == r.text for r in again)
    for giant in (300, 10**6):
        digest = pieces.encode(docs, ["doc_id"], ("n_tokens", "round_trip", "ids_sha256"), giant=giant, size=128).collect()
        assert len(digest) == len(rows) and all(r.round_trip in (True, None) for r in digest)
    assert pieces.encode(docs.where("doc_id < -1")).count() == 0


def test_products_are_associative():
    import numpy as np

    rng = np.random.default_rng(0)
    ms = [np.where(rng.random((3, 3)) < 0.5, 0.0, -np.inf) for _ in range(3)]
    times = lambda a, b: (a[:, :, None] + b[None]).max(1)
    assert np.array_equal(times(times(ms[0], ms[1]), ms[2]), times(ms[0], times(ms[1], ms[2])))


def test_each_segment_is_searched_once():
    p = pieces.Pieces(pieces.MODEL)
    text = " ".join(f"{'x' * 60}{k}" for k in range(40)) + " end"
    seen, search = [], p.segment
    p.segment = lambda t: seen.append(t) or search(t)
    assert pieces.encode_giant(text, p, 400) == p.lib.encode(text)
    # too long to be kept, so a second search would show
    assert len(seen) == len(set(seen)) > 20
