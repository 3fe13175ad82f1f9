import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from helpers import WORD, documents, lower, sample
from pyspark.sql import functions as F

from lodestone.llm import kneser
from lodestone.llm.common import crc_mod


def brute(rows, train):
    """The model in dictionaries: returns score(text) -> (n, known, base, model)."""
    tok = lambda t: [*WORD.findall(lower(t or "")), "\0end"]
    uni, pair = Counter(), Counter()
    for t in train:
        x = tok(t)
        uni.update(x)
        pair.update(zip(["\0begin", *x], x))
    N, V = sum(uni.values()), len(uni)
    before, ctx = defaultdict(set), defaultdict(Counter)
    for (a, b), n in pair.items():
        before[b].add(a)
        ctx[a][b] = n
    D = kneser.discounts([sum(n == k for n in pair.values()) for k in (1, 2, 3, 4)])
    m = {w: len(s) for w, s in before.items()}
    d = kneser.discounts([sum(n == k for n in m.values()) for k in (1, 2, 3, 4)])
    cut = lambda n, x: [0, *x][min(n, 3)]
    M = len(pair)
    h = sum(cut(n, d) for n in m.values()) / M if M else 0

    def q(w):
        n = m.get(w, 0)
        return (n - cut(n, d)) / M + h / (V + 1)

    def p(a, w):
        if a not in ctx:
            return q(w)
        every = sum(ctx[a].values())
        n = ctx[a].get(w, 0)
        return (n - cut(n, D)) / every + sum(cut(x, D) for x in ctx[a].values()) / every * q(w)

    def score(t):
        x = tok(t)
        return len(x), sum(w in uni for w in x), sum(math.log10((uni[w] + 1) / (N + V + 1)) for w in x), sum(math.log10(p(a, w)) for a, w in zip(["\0begin", *x], x)), N

    words = list(uni)
    return score, lambda a: sum(p(a, w) for w in words) + p(a, "\0unknown")


def test_equals_brute_force(spark):
    rows = sample()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    score, mass = brute(rows, [r[1] for r in rows if not held(r[0])])
    for context in ("\0begin", "w1", "w2", "never"):
        assert abs(mass(context) - 1) < 1e-9
    docs = documents(spark, rows).withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)))
    got = kneser.score_texts(docs, kneser.Model(docs, ~F.col("held_out")), ["doc_id", "held_out", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, base, model, N = score(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, N, held(r.doc_id))
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert abs(r.score - model) < 1e-6 * max(1, abs(model))


def brute_trigrams(train):
    """The model of order 3 in dictionaries: score(text), and the mass of all words and one unknown after two words."""
    tok = lambda t: [*WORD.findall(lower(t or "")), "\0end"]
    three = Counter()
    for t in train:
        x = ["\0begin", "\0begin", *tok(t)]
        three.update(zip(x, x[1:], x[2:]))
    levels = [three]
    for _ in range(2):  # distinct words before what is left without the first
        levels.append(Counter(k[1:] for k in levels[-1]))
    V = len(levels[2])
    D = [kneser.discounts([sum(n == k for n in level.values()) for k in (1, 2, 3, 4)]) for level in levels]
    cut = lambda n, x: [0, *x][min(n, 3)]
    after = [defaultdict(list) for _ in levels]
    for level, own in zip(levels, after):
        for k, n in level.items():
            own[k[:-1]].append(n)

    def p(gram):
        level = 3 - len(gram)
        lower_p = p(gram[1:]) if len(gram) > 1 else 1 / (V + 1)
        counts = after[level].get(gram[:-1])
        if not counts:
            return lower_p
        n = levels[level].get(gram, 0)
        return (n - cut(n, D[level])) / sum(counts) + sum(cut(c, D[level]) for c in counts) / sum(counts) * lower_p

    def score(t):
        x = ["\0begin", "\0begin", *tok(t)]
        return sum(math.log10(p(g)) for g in zip(x, x[1:], x[2:]))

    return score, lambda a, b: sum(p((a, b, w)) for (w,) in levels[2]) + p((a, b, "\0unknown"))


def test_order_three_equals_brute_force(spark):
    rows = [*sample(seed=3, vocabulary=12), (600, "w1 w2 w4 " * 300), (601, "unseen w1 also unseen")]
    held = lambda i: i is not None and i % 4 == 1
    score, mass = brute_trigrams([r[1] for r in rows if not held(r[0])])
    for context in (("\0begin", "\0begin"), ("\0begin", "w1"), ("w1", "w2"), ("never", "w2"), ("never", "never")):
        assert abs(mass(*context) - 1) < 1e-9
    docs = documents(spark, rows)
    model = kneser.Model(docs, F.coalesce(F.col("doc_id") % 4 != 1, F.lit(True)), order=3)
    for r in kneser.score_texts(docs, model, ["text"]).collect():
        assert abs(r.score - score(r.text)) < 1e-6 * max(1, abs(r.score))
    none = docs.where("doc_id < 0")
    assert kneser.score_texts(none, kneser.Model(none, F.lit(True), order=3), ["doc_id"]).count() == 0


def test_counts_past_32_bits_are_sent_whole():
    counts = np.array([1, 2**32 - 1, 2**32 + 5, 3 * 2**32])
    sent = Counter()
    for kind, data, n in ((k, d, n) for _, k, n, d in kneser._counted("", np.arange(4, dtype=np.uint64) << np.uint64(62), counts, 2)):
        for key, c in zip(*kneser._uncounted(kind, n, data)):
            sent[int(key) >> 62] += int(c)
    assert [sent[k] for k in range(4)] == counts.tolist()


def test_large_counts_and_empty_table(spark):
    rows = [(i, "a b a b a b " * 60) for i in range(4)]
    score, _ = brute(rows, [r[1] for r in rows])
    docs = documents(spark, rows)
    got = kneser.score_texts(docs, kneser.Model(docs, F.lit(True)), ["doc_id", "text"]).collect()
    assert all(abs(r.score - score(r.text)[3]) < 1e-6 * abs(r.score) for r in got)
    none = documents(spark, [(1, "x")]).where("doc_id < 0")
    assert kneser.score_texts(none, kneser.Model(none, F.lit(True)), ["doc_id"]).count() == 0
    assert kneser.score_texts(docs, kneser.Model(docs, F.lit(False)), ["doc_id"]).count() == 4


def test_pair_keys_invert():
    a, b = np.array([0, 5, 2**32 - 1]), np.array([7, 0, 2**31])
    x, y = kneser.pair_of(kneser.pair_key(a, b))
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist()
