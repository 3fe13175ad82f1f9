import hashlib

import xxhash
from helpers import documents, sample
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import merkle


def signed(text):
    """Spark's hash of a text: XXH64 with seed 42, signed; a null keeps the seed."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        lost = merkle.diff(merkle.build_tree(text), merkle.build_tree(changed))
        out.append((lost[0][0] if lost else None, sum(b - a for a, b in lost), i, len(text), hashlib.sha256(changed.encode()).hexdigest(), merkle.fingerprint(text), merkle.fingerprint(changed), merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(after))))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rows = sample()
    for part in (rows, rows[:1], rows[:2]):
        got = merkle.fingerprint_with_next(documents(spark, part)).collect()
        assert sorted(((r.edit_start, r.edit_chars, r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_next) for r in got), key=str) == expected(part)
        assert all(0 <= r.near_edited <= 1 for r in got)
    assert merkle.fingerprint_with_next(documents(spark, rows).where("doc_id < -1")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdé \n", max_size=120), st.text(alphabet="abcdé \n", max_size=120))
def test_roots_tell_equality(a, b):
    x, y = merkle.build_tree(a), merkle.build_tree(b)
    assert x.digest.hex() == merkle.fingerprint(a)[:32]
    assert (x.digest == y.digest) == (a == b)
    assert (merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) == 1.0) == (a == b)
    assert (merkle.diff(x, y) == []) == (a == b) or not merkle.diff(x, y)


def test_one_id_and_null_ids_with_many_rows_spread(spark):
    rows = [(7, f"text {k} of seven") for k in range(90)] + [(None, f"text {k} of none") for k in range(90)] + [(k, f"text of {k}") for k in range(60)]
    got = merkle.fingerprint_with_next(documents(spark, rows))
    assert sorted(((r.edit_start, r.edit_chars, r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_next) for r in got.collect()), key=str) == expected(rows)
    seen = [(r.doc_id, r.p) for r in got.select("doc_id", merkle.F.spark_partition_id().alias("p")).distinct().collect()]
    assert len([p for i, p in seen if i == 7]) >= 2 and len([p for i, p in seen if i is None]) >= 2


def test_diff_locates_an_edit():
    text = "\n".join(" ".join(f"word{i}x{j}" for j in range(20)) for i in range(30))
    at = text.index("word17x9")
    ranges = merkle.diff(merkle.build_tree(text), merkle.build_tree(text.replace("word17x9", "other")))
    assert any(a <= at < b for a, b in ranges)
    assert sum(b - a for a, b in ranges) < 120
