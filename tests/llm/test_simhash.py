import random

import xxhash
from helpers import WORD, documents, lower, sample

from lodestone.llm import simhash
from lodestone.llm.graph import components


def reference(text):
    w = WORD.findall(lower(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """fingerprint -> smallest fingerprint reachable by links of at most two bits."""
    fps, root = sorted(set(fps)), {}
    for f in fps:
        if f in root:
            continue
        todo, root[f] = [f], f
        while todo:
            x = todo.pop()
            for y in fps:
                if y not in root and (x ^ y).bit_count() <= 2:
                    root[y] = f
                    todo.append(y)
    return root


def check(spark, rows, bucket):
    got = simhash.near_duplicates(documents(spark, rows), bucket).collect()
    assert len(got) == len(rows)
    root = classes([reference(t) for _, t in rows])
    least = {}
    for i, t in rows:
        r = root[reference(t)]
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    expected = sorted(((i, reference(t), least[root[reference(t)]]) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=str) == expected


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = sample()
    base = [f"v{rng.randrange(500)}" for _ in range(400)]
    for i in range(80):  # near copies: a few words changed in a long text
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(400)] = f"n{rng.randrange(99)}"
        rows.append((2000 - i, " ".join(text)))
    check(spark, rows, 64)
    check(spark, rows, 2)


def test_every_planned_threshold_keeps_all_links(spark, monkeypatch):
    rng = random.Random(9)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = {c for c in centre}
    for c in centre:
        for _ in range(60):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    distinct = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    root = classes(fps)
    groups = lambda m: simhash.group_bits(1, __import__("numpy").eye(64), m)
    for m, thresholds in ((2, (1, 0)), (3, (0, 0, 0)), (3, (1, 0, -1)), (4, (0, 0, 0, -1)), (4, (1, -1, 0, -1))):
        monkeypatch.setattr(simhash, "plan", lambda d, t=thresholds, m=m: [(simhash.mask_of(b), x, b) for b, x in zip(groups(m), t) if x >= 0])
        for bucket in (64, 1):
            found = {r.vertex & (2**64 - 1): r.root for r in components(simhash.links(distinct, bucket)).collect()}
            seen = {}
            for f in fps:
                seen.setdefault(found.get(f, ("alone", f)), set()).add(root[f])
            assert all(len(x) == 1 for x in seen.values()) and len(seen) == len(set(root.values()))


def test_allocation_is_cheapest():
    cost, t = simhash.allocate([{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 9, 1: 11}], 1)
    assert (cost, t) == (16, [0, 1])


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [(1, "a")]).where("doc_id > 5")).count() == 0
