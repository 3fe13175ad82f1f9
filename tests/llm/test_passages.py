import hashlib
import random

from helpers import WORD, documents, sample

from lodestone.llm import passages


def brute(rows):
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first.get(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def table():
    rng = random.Random(5)
    fresh = lambda n: [f"{rng.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(n) for n in (50, 55, 93, 300, 49)]
    rows = sample()
    for i in range(40):
        text = fresh(rng.randint(0, 60))
        for s in rng.sample(shared, 2):
            text += s[: rng.choice([len(s), 50, 60])] + fresh(rng.randint(0, 5))
        rows.append((1000 - i, "  ".join(text) + "\n"))
    return rows


def test_equals_brute_force(spark):
    rows = table()
    docs = documents(spark, rows)
    finder = passages.Finder(docs)
    assert finder.count and finder.phrases
    got = sorted([tuple(r) for r in passages.locate(docs, finder).collect()], key=str)
    assert got == brute(rows)
    cut = passages.cut(docs, finder).collect()
    assert len(cut) == len(rows)
    assert sorted(((r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in cut), key=str) == sorted(((x[0], x[3]) for x in got), key=str)
    untouched = {(r.doc_id, r.text) for r in cut if not r.n_removed}
    assert untouched <= set(rows)


def test_many_automata_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(passages, "PER_AUTOMATON", 5)
    rows = table()
    docs = documents(spark, rows)
    finder = passages.Finder(docs)
    assert finder.automata > 2
    assert sorted([tuple(r) for r in passages.locate(docs, finder).collect()], key=str) == brute(rows)
    assert passages.locate(docs.where("doc_id < -5")).count() == 0
