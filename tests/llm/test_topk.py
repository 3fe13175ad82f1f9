import math
import random

from lodestone.llm import topk


def brute(rows, k=5, every=50):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(256 * x) for x in v]))
    out = set()
    for qi, q in {(i, tuple(v)) for i, v in usable if i % every == 0}:
        clamp = lambda x: max(-(2**63), min(2**63 - 1, x))
        scores = sorted(((-clamp(sum(a * b for a, b in zip(q, v))), i) for i, v in usable if i != qi))
        out |= {(qi, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<float>, label int, norm double").repartition(3)


def run(spark, rows, **options):
    got = [tuple(r) for r in topk.search(topk.quantize(table(spark, rows)), **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    vec = lambda s=1.0: [rng.choice([s * rng.gauss(0, 0.2) for _ in range(3)]) for _ in range(8)]
    rows = [(i, [float(x) for x in __import__("numpy").float32(vec(1 + i % 7))]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 460)]  # copies: ties
    rows += [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (950, [0.0] * 8), (951, []), (1000, [0.5] * 3), (None, [9.0] * 8)]
    expected = brute(rows)
    assert run(spark, rows) == expected
    assert run(spark, rows, query_chunk=4, stages=3, sample_every=2) == expected


def test_equal_norms_are_dealt_to_all_ranges(spark):
    seen = []
    real = topk.materialize
    try:
        topk.materialize = lambda df, what: seen.append(df) or real(df, what)
        run(spark, [(i, [float(k == i % 16) for k in range(16)]) for i in range(800)])
    finally:
        topk.materialize = real
    sizes = [r["count"] for r in seen[0].groupBy(topk.F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_few_rows(spark):
    assert run(spark, [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [-1.0, 0.0])]) == brute([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [-1.0, 0.0])])
    assert run(spark, [(0, [1.0])]) == set()
    assert topk.search(topk.quantize(table(spark, [(0, [1.0])]).where("vec_id > 3"))).count() == 0


def test_large_components(spark):
    rows = [(0, [1e7, 2e7]), (1, [3e7, -4e7]), (2, [2e7, 2.5e7]), (50, [1e6, 3.0])]
    assert run(spark, rows) == brute(rows)
