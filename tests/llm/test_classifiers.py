import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from helpers import documents
from pyspark.sql import functions as F

from lodestone.llm import langid, mixing, quality, toxicity
from lodestone.llm.common import crc_mod, text_slices
from lodestone.llm.words import mix, split_words

AWKWARD = [(9001, None), (9002, ""), (9003, " \n"), (9004, "1234 !!"), (9005, "word " * 4000), (None, "the cat"), (9006, "x")]


def texts(seed=4, n=240):
    """(doc_id, text, lang, quality, toxic): two languages, junk with marks, toxic stems."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        parts = ["the", "ing", "ation", "ther", "and"] if lang == "aa" else ["uk", "ölz", "zza", "pri", "kro"]
        words = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), "grumph" + rng.choice(["el", "ok", "isch", "a"]))
        good = int(rng.random() < 0.7)
        out.append((i, " ".join(words) if good else " | ".join(w + "$$" for w in words), lang, good, toxic))
    return out


def tables(spark, rows):
    docs = documents(spark, [r[:3] for r in rows] + [(i, t, None) for i, t in AWKWARD] + [rows[0][:3]])
    labels = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows] + [(9002, None, None), (9001, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def held(i, mod=5, k=0):
    return zlib.crc32(str(i).encode()) % mod == k


def test_language(spark):
    rows = texts()
    docs, _ = tables(spark, rows)
    got = langid.predict(docs.withColumn("learn", F.col("doc_id") % 3 != 1), F.col("learn")).collect()
    assert len(got) == len(rows) + len(AWKWARD) + 1
    truth = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth)
    assert {r.doc_id: r.lang_pred for r in got}[9001] == "und"
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (9001, 9002, 9003, 9004))
    assert all(0 <= r.score <= 1 for r in got)
    alone = langid.predict(docs, F.lit(False)).collect()
    assert {r.lang_pred for r in alone} == {"und"}
    assert langid.predict(docs.where("doc_id < -1"), F.lit(True)).count() == 0


def grams(text, order):
    """Codes of the n-grams of one text, one at a time in whole numbers."""
    b = " ".join("".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower()).split(" ")).split()
    b = (" " + " ".join(b) + " ").encode()
    out = set()
    for i in range(len(b) - order + 1):
        code = b[i]
        for x in b[i + 1 : i + order]:
            code = (code * 0x01000193 & 0xFFFFFFFF) ^ x
        out.add((code * 0x9E3779B1 & 0xFFFFFFFF) >> 16 if order > 2 else code & 0xFFFF)
    return out


def presence(texts):
    rows = [[] for _ in texts]
    maker = langid.Presence()
    for i, j, data, offsets in text_slices(pa.array(texts), rows=langid.ROOM, lower=True):
        for pointer, codes in maker.rows(data, offsets):
            for k in range(j - i):
                rows[i + k].append(codes[pointer[k] : pointer[k + 1]])
    return rows


def test_language_scores_are_those_of_the_kernel_machine():
    """Kernel, ridge regression on landmarks and outputs written out over sets of n-grams."""
    rows = texts(n=40)
    codes = presence([r[1] for r in rows])
    every = [[grams(r[1], k) for k in (1, 2, 3, 4)] for r in rows]
    assert all([set(x.tolist()) for x in own] == sets for own, sets in zip(codes, every))
    kernel = lambda a, b: sum(len(x & y) / math.sqrt(len(x) * len(y)) for x, y in zip(a, b)) / 4
    train, labels = every[:30], [r[2] for r in rows[:30]]
    model = langid.fit(codes[:30], labels, landmarks=10)
    by = {y: [i for i in range(30) if labels[i] == y] for y in ("aa", "bb")}
    marks = [by[y][k] for k in range(5) for y in ("aa", "bb")]
    K = np.array([[kernel(a, train[m]) for m in marks] for a in train])
    w = np.array([30 / (2 * len(by[y])) for y in labels])
    y = np.array([[1.0 if x == lang else -1.0 for lang in ("aa", "bb")] for x in labels])
    alpha = np.linalg.solve(K.T @ (K * w[:, None]) + 30 * 1e-3 * K[marks] + 1e-8 * 30 * np.eye(10), K.T @ (y * w[:, None]))
    direct = np.array([[kernel(a, train[m]) for m in marks] for a in every[30:]]) @ alpha
    found = model.outputs([langid.stack([c[k] for c in codes[30:]]) for k in range(4)])
    assert np.abs(found - direct).max() < 1e-4


def test_presence_of_long_and_empty_texts():
    long = "kro uk " * 400_000 + "!! Ähre"
    own = presence(["", "12 .", long, "kro", long[:5000]])
    assert [len(x) for x in own[0]] == [0] * 4 and [len(x) for x in own[1]] == [0] * 4
    for k in (1, 2, 3, 4):
        assert set(own[2][k - 1].tolist()) == grams("kro uk kro uk Ähre", k)
        assert set(own[3][k - 1].tolist()) == grams("kro", k)
    data = np.frombuffer("½ 7a漢".encode(), np.uint8)
    assert langid.has_letter(data, np.array([0, 3, 4, 5, 8])).tolist() == [False, False, True, True]
    full = [np.arange(n) for n in (0, 5, 4096, 60000)]
    assert [x.tolist() for x in langid.unpack(langid.pack(full))] == [x.tolist() for x in full] and len(langid.pack([np.arange(65536)] * 4)) <= 33 << 10


def test_a_language_of_one_repeated_text_is_learned(spark):
    rows = [(None, "uk zza pri kro", "bb")] * 3000 + [(i, "the cat and mat " + "abcdefgh"[i % 8] * (i % 50), "aa") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    codes, labels = langid.sample_labelled(docs, F.lit(True), 20, 1000)
    assert labels.count("bb") == 1 and labels.count("aa") == 20
    assert {r.lang_pred for r in langid.predict(docs, F.lit(True), ["text"], per_language=20).where("text like 'uk%'").collect()} == {"bb"}
    # of all languages together at most so many
    assert len(langid.sample_labelled(docs, F.lit(True), 20, 10)[1]) == 6


def test_quality(spark):
    rows = texts()
    docs, labels = tables(spark, rows)
    docs = docs.withColumn("learn", F.col("doc_id") % 5 != 0)
    got = quality.score_texts(docs, labels, "learn", ["doc_id"]).collect()
    assert len(got) == len(rows) + len(AWKWARD) + 1 and all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: r[3] for r in rows if r[0] % 5 == 0}
    assert all(r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth)
    none = quality.score_texts(docs, labels.where("doc_id < -1"), "learn", ["doc_id"]).collect()
    assert {r.score for r in none} == {0.5}
    one = quality.score_texts(docs, labels.where("quality = 1"), "learn", ["doc_id"]).collect()
    assert {r.predicted for r in one} == {1}
    assert quality.score_texts(docs.where("doc_id < -1"), labels, "learn", ["doc_id"]).count() == 0


def test_quality_density_is_gaussian():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, quality.SIZE))
    m = {k: (len(p), p.sum(0), p.T @ p) for k, p in ((0, x[:80]), (1, x[80:] + 1))}
    d = quality.Discriminant(m, shrink=0.0, ridge=0.0)
    own = x[:80]
    cov = np.cov(own.T, bias=True) + 1e-4 * np.eye(quality.SIZE)
    y = x[:3]
    dev = y - own.mean(0)
    direct = -0.5 * np.einsum("ij,jk,ik->i", dev, np.linalg.inv(cov), dev) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(0.4)
    mean, inverse, log_det, prior = d.parts[0]
    z = (y - mean) @ inverse.T
    assert np.allclose(direct, -0.5 * (z * z).sum(1) - log_det + prior)


def statistics_of(text):
    """The statistics of one text, by plain loops."""
    raw = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))) if w]
    shown = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    lines = [x for x in raw.split(b"\n") if x]
    b, w = max(1, len(raw)), max(1, len(words))
    share = lambda chars: sum(c in chars for c in raw) / b
    rate = lambda x: math.log(x + quality.TINY)
    sizes = [len(x) for x in words]
    mean = sum(sizes) / w
    symbol = b"|#$%&*+<>=@[]^_`{}~/\\"
    known = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \t\n\x0b\x0c\r.,;:!?" + symbol
    return [
        math.log1p(len(words)), math.log1p(mean), math.log1p(math.sqrt(max(0, sum(x * x for x in sizes) / w - mean * mean))),
        rate(share(bytes(range(65, 91)))), rate(share(b"0123456789")), rate(share(b".,;:")), rate(share(b"!?")), rate(share(symbol)), rate(sum(c >= 128 for c in raw) / b),
        rate(sum(c < 128 and c not in known for c in raw) / b), rate(1 - len(set(words)) / w), rate(sum(x == y for x, y in zip(words, words[1:])) / w),
        rate(sum(x[-1] in b"!?" + symbol for x in shown) / w), rate(sum(65 <= x[0] <= 90 for x in shown) / w), rate(1 - len(set(lines)) / max(1, len(lines))), math.log1p(len(words) / max(1, len(lines))),
    ]


def test_quality_equals_brute_force(spark):
    """Statistics, class moments, densities and logistic of every row, written out."""
    rows = texts(n=120)
    docs, labels = tables(spark, rows)
    every = [(r.doc_id, r.text or "") for r in docs.collect()]
    x = {t: np.array(statistics_of(t)) for _, t in every}
    for _, t in every[:20]:
        data = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(quality.statistics(data, np.array([0, len(data)]))[0], x[t])
    label = {r[0]: r[3] for r in rows} | {9001: 1}
    train = [(label[i], x[t]) for i, t in every if i in label and not held(i)]
    own = {y: np.array([v for k, v in train if k == y]) for y in (0, 1)}
    scatter = {y: (v - v.mean(0)).T @ (v - v.mean(0)) for y, v in own.items()}
    pooled = (scatter[0] + scatter[1]) / len(train)
    density = {}
    for y, v in own.items():
        cov = 0.9 * scatter[y] / len(v) + 0.1 * pooled
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + 1e-4 * np.eye(quality.SIZE)
        density[y] = lambda z, m=v.mean(0), c=cov, n=len(v): -0.5 * (z - m) @ np.linalg.solve(c, z - m) - 0.5 * np.linalg.slogdet(c)[1] + math.log(n / len(train))
    margin = lambda z: math.asinh(density[1](z) - density[0](z))
    m = np.round(np.array([margin(z) for _, z in train]) * 16) / 16
    a, b = toxicity.logistic(np.stack([m, np.ones(len(m))], 1), np.array([float(y) for y, _ in train]), np.full(len(m), 1 / len(m)))
    docs = docs.withColumn("learn", ~F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)))
    for r in quality.score_texts(docs, labels, "learn", ["doc_id", "text"]).collect():
        assert abs(r.score - 1 / (1 + math.exp(-a * margin(x[r.text or ""]) - b))) < 1e-4


def test_toxic_scores_equal_brute_force(spark):
    """Subwords, word and window averages and the logistic of every row, word by word."""
    docs, labels = tables(spark, texts(n=120))
    model = toxicity.train(docs, labels, F.lit(True))
    a, b, c = model.logistic

    def margin(word):
        data = np.frombuffer(word, np.uint8)
        _, _, h, _ = split_words(data, np.array([0, len(data)]), space=toxicity.BREAKS)
        marked = b"<" + word + b">"
        rows = [int(mix(h + np.uint64(77))[0] >> np.uint64(64 - toxicity.BITS))]
        for k in toxicity.GRAMS:
            for i in range(len(marked) - k + 1):
                code = 0
                for x in marked[i : i + k]:
                    code = (code * 0x100000001B3 + x + 1) % 2**64
                rows.append(int(mix(np.array([(code + k) % 2**64], np.uint64))[0] >> np.uint64(64 - toxicity.BITS)))
        return sum(model.row_margin[r] for r in rows) / len(rows)

    for r in toxicity.score_texts(docs, model, ["text"]).where("length(text) < 3000 or text is null").collect():
        words = [w for w in re.split(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (r.text or "").lower().encode()) if w]
        own = [margin(w) for w in words]
        top = max((sum(own[k : k + 5]) / len(own[k : k + 5]) for k in range(max(1, len(own) - 4))), default=0.0) if own else 0.0
        assert abs(r.score - 1 / (1 + math.exp(-(a * (top + model.bias) + b + c * math.log1p(len(words)))))) < 1e-6


def test_training_texts_are_bounded(spark, monkeypatch):
    """Four ids on 10,000 rows each: texts reach the driver once, however often they stand in the table."""
    docs = spark.range(40_000).select((F.col("id") % 4).alias("doc_id"), F.concat(F.lit("word"), (F.col("id") % 8).cast("string")).alias("text"))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, share: seen.append((sorted(texts), share)) or toxicity.constant(share))
    toxicity.train(docs, labels, F.lit(True))
    assert seen == [([f"word{k}" for k in range(8)], 0.5)]
    toxicity.train(docs.withColumn("text", F.repeat("text", F.when(F.col("text") == "word3", 100).otherwise(1))), labels, F.lit(True), longest=400)
    assert len(seen[1][0]) == 7
    toxicity.train(docs, labels, F.lit(True), most_chars=10)
    assert len(seen[2][0]) == 4
    rows = docs.select("doc_id", "text").withColumn("u", F.lit(0.5)).withColumn("x", F.array(*[F.lit(0.0)] * 17))
    marks = labels.select("doc_id", F.col("toxic").alias("y"))
    taken = []
    monkeypatch.setattr(mixing, "Classifier", lambda x, y: taken.append(len(y)))
    mixing._classifier(rows, marks, 3)
    mixing._classifier(rows, marks, 100)
    assert taken == [3, 4]


def test_toxicity(spark):
    rows = texts()
    docs, labels = tables(spark, rows)
    model = toxicity.train(docs, labels, F.col("doc_id") % 5 != 0)
    got = toxicity.score_texts(docs, model, ["doc_id"]).collect()
    assert len(got) == len(rows) + len(AWKWARD) + 1 and all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: r[4] for r in rows if r[0] % 5 == 0}
    right = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth]
    assert sum(right) >= 0.9 * len(right)
    unseen = toxicity.score_texts(documents(spark, [(1, "the and ther grumphixoo ing"), (2, "the and ther thering ing")]), model, ["doc_id"]).collect()
    by = {r.doc_id: r.score for r in unseen}
    assert by[1] > by[2]
    none = toxicity.score_texts(docs, toxicity.train(docs, labels.where("doc_id < -1"), F.lit(True)), ["doc_id"]).collect()
    assert all(r.score < 1e-6 for r in none)
    assert toxicity.score_texts(docs.where("doc_id < -1"), model, ["doc_id"]).count() == 0


def test_both_users_train_on_2500_texts_a_class(spark, monkeypatch):
    docs = documents(spark, [(i, f"word{i}") for i in range(6000)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(6000)], "doc_id long, quality int, toxic int")
    seen = []

    class Enough(Exception):
        pass

    def fit(texts, toxic, share):
        seen.append((len(texts), int(toxic.sum())))
        raise Enough

    monkeypatch.setattr(toxicity, "fit", fit)
    for run in (lambda: toxicity.train(docs, labels, F.lit(True)), lambda: mixing.mix(docs, labels), lambda: mixing.mix(docs, labels, most_toxic=100)):
        try:
            run()
        except Enough:
            pass
    assert seen == [(5000, 2500), (5000, 2500), (200, 100)]


def test_toxic_window_of_a_long_text_counts():
    means, begin, stop = toxicity.window_means(np.array([0.0, 0, 0, 5, 0, 0, 0, 1]), np.array([0, 7, 8]))
    assert toxicity.highest(np.array([0.0, 0, 0, 5, 0, 0, 0, 1]), np.array([0, 7, 8])).tolist() == [1.0, 1.0]
    assert (stop - begin).tolist() == [5] * 7 + [1]


def test_mixing(spark):
    rows = texts(n=400)
    docs, labels = tables(spark, rows)
    got = mixing.mix(docs, labels).collect()
    assert len(got) == len(rows) + len(AWKWARD) + 1 and all(r.rate >= 0 and r.copies >= 0 for r in got)
    mass = np.array([sum(r[f"p_{d}"] * r.n_tokens * r.rate for r in got) for d in mixing.DOMAINS])
    target = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    assert np.abs(mass / mass.sum() - target / target.sum()).max() < 0.02
    clean = {r[0] for r in rows if r[3] == 1 and r[4] == 0}
    assert np.mean([r.copies >= 1 for r in got if r.doc_id in clean]) > 0.9
    none = mixing.mix(docs, labels.where("doc_id < -1")).collect()
    assert {r.rate for r in none} == {1.0}
    assert mixing.mix(docs.where("doc_id < -1"), labels).count() == 0


def test_mixing_equals_brute_force(spark):
    """Posteriors from a softmax fitted here, rates by projected gradient over single documents."""
    rows = texts(n=160)
    docs, labels = tables(spark, rows)
    got = sorted(mixing.mix(docs, labels).collect(), key=lambda r: (str(r.doc_id), r.u))
    model = toxicity.train(docs, labels, F.lit(True))
    text = sorted(((str(r.doc_id), r.u, r.doc_id, r.text or "") for r in docs.withColumn("u", mixing.uniform()).collect()))
    z = model.score(pa.array([t for *_, t in text]))
    x = np.array([[*statistics_of(t), math.log(s + 1e-6) - math.log(1 - s + 1e-6)] for (*_, t), s in zip(text, z)])
    cell = {r[0]: 2 * (1 - r[3]) + r[4] for r in rows} | {9001: 0}
    known = {(i, u): k for k, (_, u, i, _) in enumerate(text) if i in cell}
    own = np.array(list(known.values()))
    y = np.array([cell[text[k][2]] for k in own])
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-6
    weight = mixing.softmax_regression((x[own] - mean) / scale, y, 4)
    logits = np.clip((x - mean) / scale, -50, 50) @ weight[:-1] + weight[-1]
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    found = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in got])
    assert np.abs(found - p).max() < 0.01
    tokens = np.array([r.n_tokens for r in got], float)
    assert [r.n_tokens for r in got] == [len(t.split()) for *_, t in text]
    held_mass, want = (found * tokens[:, None]).sum(0), np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    aim = np.minimum(want / want.sum() * held_mass[0] / (want[0] / want.sum()), held_mass) * 1.02 / tokens.sum()
    rate = ahead = np.ones(len(got))
    for k in range(400):
        residual = (found * (ahead * tokens)[:, None]).sum(0) / tokens.sum() - aim
        after = np.maximum(0, ahead - (found @ residual + 1e-3 * (ahead - 1)) / (1 + 1e-3))
        ahead, rate = after + k / (k + 3) * (after - rate), after
    mass = lambda r: (found * (r * tokens)[:, None]).sum(0) / tokens.sum()
    assert np.abs(mass(np.array([r.rate for r in got])) - mass(rate)).max() < 5e-3
    assert all(r.copies == math.floor(r.rate + r.u) for r in got)


def test_scarce_unwanted_domain_costs_no_wanted_documents(spark):
    for share in (0.0002, 0.003):
        groups = [([256, 0, 0, 0], 7600.0), ([0, 256, 0, 0], 400.0), ([0, 0, 256, 0], 2000.0), ([0, 0, 0, 256], 10000 * share)]
        history, anchor = mixing.fit_rates(spark.createDataFrame([g for g in groups if g[1]], "q array<int>, tokens double"), mixing.TARGETS)
        rate = mixing.replay(np.eye(4), history, anchor)[0]
        assert rate[0] >= 0.99 and rate.max() < 1.05
        assert rate[2] < 0.5 and abs(rate[2] * 2000 / (rate[0] * 7600) - 0.05 / 0.92) < 0.01


def test_replayed_rates_minimise_the_objective():
    """The projected gradient's rates are no worse than small feasible changes of them."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3] * 4, 50)
    t = rng.uniform(1, 9, 50)
    aim = np.array([0.5, 0.05, 0.05, 0.0])
    history = []
    for _ in range(600):
        ahead = mixing.replay(p, history, 1e-2)[1]
        history.append((p * (ahead * t)[:, None]).sum(0) / t.sum() - aim)
    rate = mixing.replay(p, history, 1e-2)[0]
    cost = lambda r: 0.5 * (((p * (r * t)[:, None]).sum(0) / t.sum() - aim) ** 2).sum() + 0.5e-2 * (t * (r - 1) ** 2).sum() / t.sum()
    for _ in range(200):
        other = np.maximum(0, rate + rng.normal(0, 0.05, 50))
        assert cost(rate) <= cost(other) + 1e-7
