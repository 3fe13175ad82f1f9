import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import text as T
from lodestone.operators import aggregate, cluster, extract, identity, report, state
from lodestone.plans import library as plan
from lodestone.rules import DEFAULT, LATIN
from lodestone.schemas import DEFAULTS, POST
from lodestone.sources import html, notes, readers, sinks


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def posts(spark, rows):
    full = []
    for k, r in enumerate(rows):
        base = {"platform": "平台", "title": "标题", "url": f"https://a.test/{k}", "text": "", **DEFAULTS, "collected_at": "2026-01-01T00:00:00"} | r
        full.append((*[base[c] for c in POST.fieldNames()], k))
    return spark.createDataFrame(full, POST.simpleString()[7:-1].replace(":", " ") + ", ordinal long")


@pytest.mark.parametrize(
    "text, expected",
    [("&lt;a&gt; &amp;amp; x\r\ny", "<a> &amp; x\n\ny"), (None, ""), ("　 a \t b　\n\n\n\nc ", "a b　\n\nc"), ("&#39;&hellip;", "'…")],
)
def test_clean_text(spark, text, expected):
    assert one(spark, T.clean_text("t"), t=text) == expected


@pytest.mark.parametrize("text, expected", [("一面： 1. Redis 怎么用？", "redis怎么用"), ("十二、什么是 TCP", "什么是tcp"), ("Ａb-c", "bc"), ("追问 3) X", "x")])
def test_normalize(spark, text, expected):
    assert one(spark, T.normalize_question("t"), t=text) == expected


def test_split_lines_like_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(["a", "\n", "\r", "\x0b", "\x0c", "\x85", " ", "\x1c", " "], k=rng.randint(0, 8))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.split_lines("t").alias("x")).collect()
    assert all(r.x == r.t.splitlines() for r in got)


def test_candidates_with_evidence(spark):
    text = "自我介绍环节很长\n1. Redis 缓存穿透怎么解决？ 2. TCP 为什么三次握手\n\n点赞收藏一下什么\n[图片OCR 第2页]\n- 讲讲线程与进程区别\n[图片OCR 第３页]\n4、手写快速排序"
    got = extract.candidates(posts(spark, [{"text": text}])).select("question", "evidence.*").collect()
    assert [(r.question, r.type, r.page, r.line) for r in got] == [
        ("Redis 缓存穿透怎么解决？", "text", None, 2),
        ("TCP 为什么三次握手", "text", None, 3),
        ("讲讲线程与进程区别", "ocr", 2, 7),
        ("手写快速排序", "ocr", 3, 9),
    ]
    assert got[0].excerpt.startswith("1. Redis")


@pytest.mark.parametrize("text, expected", [("面试于2025年2月30日，后来2025-3-04又面", "2025-03-04"), ("12025-01-01 09-03", ""), (None, ""), ("2024/1/2", "2024-01-02")])
def test_date(spark, text, expected):
    assert one(spark, C.infer_date("t"), t=text) == expected


def test_topic_company_business(spark):
    assert one(spark, C.topic_of("t"), t="tcp 三次握手") == "计算机网络"
    assert one(spark, C.topic_of("t"), t="今天天气") == "其他"
    assert one(spark, C.infer_company("a", "b"), a="美团面经 - 小红书", b="字节") == "美团"
    assert one(spark, C.infer_company("a", "b"), a="面经 | 小红书", b="x" * 600 + "字节") == "其他/未知"
    assert one(spark, C.infer_business("a", "b"), a="", b="推荐 搜索") == "搜索"


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTPS://www.ZhiHu.com/Question/1/?a=1#b", "p:https://www.zhihu.com/Question/1"),
        ("//zhihu.com/x;params?q", "p:https://zhihu.com/x"),
        ("https://other.test/x/?a", "p:https://other.test/x/?a#t"),
        ("http://zhihu.com:80", "p:http://zhihu.com:80"),
    ],
)
def test_identity(spark, url, expected):
    assert one(spark, C.post_identity("p", "u", "t"), p="p", u=url, t="t") == expected


def test_latest_version_and_ties(spark):
    base = {"url": "https://zhihu.com/q"}
    rows = [base | {"text": "aa", "title": "first"}, {"url": "https://b.test", "text": "b"}, base | {"text": "aaa", "title": "longest"}, base | {"text": "aaa", "title": "later tie", "collected_at": "2026-01-01T00:00:00"}, base | {"text": "aaa", "collected_at": "2025", "title": "older"}]
    got = {r.identity: r for r in identity.latest(posts(spark, rows)).collect()}
    best = got["平台:https://zhihu.com/q"]
    assert (best.title, best.ordinal, len(got)) == ("longest", 0, 2)
    assert len(best.source_id) == 16


def test_enrich(spark):
    rows = [{"platform": "小红书", "title": "字节一面", "text": "[图片OCR 第1页]\n推荐 2025-01-02", "downloaded_image_count": 1, "url": "https://x.test/explore/n1"}, {"text": "没有", "company": "原来", "business": "", "date": "2020-01-01"}]
    images = spark.createDataFrame([("n1", 4)], "note_id string, downloaded int")
    a, b = identity.enrich(posts(spark, rows), images=images).orderBy("ordinal").collect()
    assert (a.company, a.business, a.date, a.collection_depth, a.ocr_page_count, a.downloaded_image_count, a.is_complete) == ("字节跳动", "推荐", "2025-01-02", "deep", 1, 4, False)
    assert (b.company, b.business, b.date, b.is_complete) == ("原来", "", "2020-01-01", True)


def greedy(rows, threshold):
    """Clusters in order, by the plain sequential walk."""
    reps, out = [], {}
    for seq, norm in sorted(rows):
        for rep_seq, rep in reps:
            if rep[:2] == norm[:2] and (norm in rep or rep in norm or difflib.SequenceMatcher(None, norm, rep).ratio() >= threshold):
                out[norm] = out.get(norm, rep_seq)
                break
        else:
            reps.append((seq, norm))
            out.setdefault(norm, seq)
    return out


def test_normal_form_of_every_character(spark):
    texts = ["".join(map(chr, range(a, a + 256))) for a in range(0, 0xD800, 256)] + ["a\0b 1\U0001F600c", "éa-b", "ab c"]
    got = [r[0] for r in spark.createDataFrame([(k, "x" + t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(T.normalize_question("t")).collect()]
    assert [g[:1] for g in got] == ["x"] * len(got)
    expected = ["".join(c for c in "x" + t if c.isascii() and (c.isdigit() or c.islower()) or "一" <= c <= "鿿") for t in texts]
    # upper case becomes lower case first; only blocks without it are held against the plain rule
    assert all(g == e for g, e, t in zip(got, expected, texts) if t == t.lower())


def test_white_space_and_lines_without_regular_expressions(spark, capsys):
    spaces = [c for c in map(chr, range(0x11000)) if c.isspace()]
    texts = [f"{c}{d}a{c}b\r\n{d}{c}" for c in spaces for d in ("", "\r", "\u2028", "x")] + ["", "\n", "\r\r\n\n", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip("t").alias("s"), T.split_lines("t").alias("l"))
    assert all(r.s == r.t.strip() and r.l == r.t.splitlines() for r in df.collect())
    df.explain()
    assert "regexp" not in capsys.readouterr().out


def test_far_lengths_are_not_compared(monkeypatch):
    """Forms too short or long for the ratio are only looked up for containment."""
    rng = random.Random(5)
    words = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    old = [words(rng.choice([1, 3, 5, 20, 130])) for _ in range(600)]
    new = [words(60) for _ in range(40)] + [old[7] + "zz", "z" + old[9], "zzzzz"]
    seen = []
    monkeypatch.setattr(cluster._Chunk, "common", (lambda f: lambda self, text: seen.append((len(text), self.size)) or f(self, text))(cluster._Chunk.common))
    got = set(cluster._matches(new, [1] * len(new), old, [0] * len(old), 0.84))
    assert got == {(i, j) for i, a in enumerate(new) for j, b in enumerate(old) if a in b or b in a or cluster.ratio(a, b) >= 0.84}
    assert not [n for n, size in seen if n == 60 and size.max() <= 20]


def test_lines_are_made_once(spark, capsys):
    posts = spark.range(3).selectExpr("id AS ordinal", "concat('1. a\n2. b &amp; ', id) AS text")
    for df in (extract.lines(posts), extract.candidates(posts)):
        df.explain()
        plan_text = capsys.readouterr().out
        assert plan_text.count("ArrowEvalPython [") == 1
        assert "size(transform(" not in plan_text


@pytest.mark.parametrize("threshold, chunk", [(0.84, 1024), (0.7, 5), (0.84, 3)])
def test_near_clusters_equal_the_sequential_walk(spark, threshold, chunk):
    rng = random.Random(chunk)
    forms = []
    for _ in range(120):
        base = rng.choice(["ab", "ac"]) + "".join(rng.choices("abcde", k=rng.randint(3, 30)))
        forms += [base, base[: rng.randint(2, len(base))], "".join(c for c in base if rng.random() < 0.93), "ab" + "".join(rng.sample(base, len(base)))]
    rng.shuffle(forms)
    rows = [(f"{k:06d}", f) for k, f in enumerate(forms) if f]
    got = cluster.cluster_forms(spark.createDataFrame(rows, "seq string, norm string"), threshold, chunk=chunk).collect()
    assert {r.norm: r.cluster for r in got} == greedy(rows, threshold)


def words_of(rng, n):
    parts = ["th", "he", "er", "in", "an", "at", "ing", "en", "st", "ou", "of", "is"]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.84, 0.95, 1.0])
def test_bounds_lose_no_match(monkeypatch, threshold):
    """Near copies with their changes anywhere, at any length, pass every bound; each pair is found once."""
    rng = random.Random(int(threshold * 100))
    forms = []
    for _ in range(60):
        base = words_of(rng, rng.randint(1, 60)) + rng.choice(["", "漢字" * rng.randint(1, 40)])
        cut = rng.randint(0, len(base))
        some = "".join(rng.choice("thearq") for _ in range(rng.randint(0, len(base) // 3)))
        forms += [base, base[:cut] + some + base[cut:], base[:cut] + base[cut + len(some) :], some + base, "".join(c if rng.random() < 0.9 else "q" + c for c in base)]
    forms = list(dict.fromkeys(f for f in forms if f))
    rng.shuffle(forms)
    seq = list(range(len(forms)))
    monkeypatch.setattr(cluster, "FEW", 0)
    good = lambda i, j: forms[i] in forms[j] or forms[j] in forms[i] or cluster.ratio(forms[max(i, j)], forms[min(i, j)]) >= threshold
    half = len(forms) // 2
    got = list(cluster._matches(forms[:half], seq[:half], forms[half:], seq[half:], threshold))
    assert len(set(got)) == len(got)
    assert set(got) == {(i, j) for i in range(half) for j in range(len(forms) - half) if good(i, half + j)}
    got = [tuple(sorted(x)) for x in cluster._matches(forms, seq, forms, seq, threshold)]
    assert len(set(got)) == len(got)
    assert set(got) == {(i, j) for j in seq for i in range(j) if good(i, j)}


def test_few_pairs_reach_the_subsequence(monkeypatch):
    """Pairs of like lengths are held off by products of grams; only one in several is compared, and in one direction."""
    rng = random.Random(9)
    forms = ["".join(rng.choice("etaoinshrdlu") for _ in range(80)) for _ in range(400)]
    seen = []
    for name in ("common", "among"):
        if hasattr(cluster._Chunk, name):
            monkeypatch.setattr(cluster._Chunk, name, (lambda f: lambda self, *a: seen.append(len(out := f(self, *a))) or out)(getattr(cluster._Chunk, name)))
    found = list(cluster._matches(forms, list(range(400)), forms, list(range(400)), 0.84))
    assert not [x for x in found if x[0] != x[1]]
    assert sum(seen) < 400 * 399 / 2 / 4


def test_common_subsequence_bound():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    rng = random.Random(3)
    forms = ["".join(rng.choices("abc漢", k=rng.randint(1, 40))) for _ in range(30)]
    chunk = cluster._Chunk(forms)
    for _ in range(20):
        text = "".join(rng.choices("abcd漢", k=rng.randint(1, 40)))
        assert chunk.common(text).tolist() == [lcs(text, f) for f in forms]


def question_rows(spark, rows):
    schema = "cluster string, seq string, norm string, question string, topic string, company string, business string, platform string, confidence string, source_id string, is_complete boolean"
    return spark.createDataFrame(rows, schema).withColumn("source", F.struct("source_id", "is_complete"))


def test_aggregates(spark):
    rows = [
        ("c", "1", "n1", "q1", "t", "", "b2", "p", "Z", "s1", False),
        ("c", "2", "n2", "q2", "t", "y", "", "p", "C", "s1", True),
        ("c", "3", "n3", "q3", "u", "x", "b1", "o", "B", "s2", None),
        ("d", "4", "m", "q", "t", "x", "b", "p", "A", "s1", False),
    ]
    got = {r.question_id: r for r in aggregate.questions(question_rows(spark, rows)).collect()}
    import hashlib

    c, d = (got[hashlib.sha1(x.encode()).hexdigest()[:16]] for x in ("n1", "m"))
    assert (c.question, c.topic, c.frequency, c.confidence) == ("q1", "t", 2, "B")
    assert (c.companies, c.platforms, c.businesses) == (["", "x", "y"], ["o", "p"], ["b1", "b2"])
    assert c.quality_score == 0.75 and d.quality_score == 0.82
    assert [s.source_id for s in c.sources] == ["s1", "s2"]


@pytest.mark.parametrize("level, n, poor, score", [("A", 1, False, 0.9), ("A", 9, False, 1.0), ("B", 3, True, 0.7), ("C", 2, False, 0.55), ("?", 1, True, 0.37)])
def test_quality(spark, level, n, poor, score):
    assert one(spark, aggregate.quality_score(F.col("l"), F.col("n"), F.col("p")), l=level, n=n, p=poor) == score


def test_build_save_search(spark, tmp_path):
    rows = [
        {"title": "美团一面", "text": "1. Redis 缓存穿透怎么解决？\n2. TCP 为什么需要三次握手？", "confidence": "A"},
        {"title": "字节二面", "text": "1、Redis缓存穿透怎么解决\n2、讲讲虚拟内存", "is_complete": False},
    ]
    library = plan.build(posts(spark, rows))
    sinks.save_library(library, str(tmp_path / "lib"))
    sinks.save_library(library, str(tmp_path / "lib"))  # rebuilt in place
    kept = sinks.load_library(spark, str(tmp_path / "lib"))
    q = {r.question: r for r in kept.questions.collect()}
    assert q["Redis 缓存穿透怎么解决？"].frequency == 2 and q["Redis 缓存穿透怎么解决？"].companies == ["字节跳动", "美团"]
    assert spark.read.parquet(str(tmp_path / "lib/question_sources")).count() == 4
    asked = spark.createDataFrame([(1, "缓存穿透"), (2, "三次握手"), (3, "nothing here")], "query_id long, query string")
    found = plan.search_library(kept, asked, top_k=1).collect()
    assert [(r.query_id, r.question) for r in found] == [(1, "Redis 缓存穿透怎么解决？"), (2, "TCP 为什么需要三次握手？")]
    assert found[0].sources[0].url.startswith("https://a.test/")
    page = sinks.render_html(kept)
    assert "缓存穿透" in page and "PAYLOAD" not in page
    assert report.stats(kept.posts, kept.questions).first().high == 1
    cards = {r.question: r for r in report.question_cards(kept.questions).collect()}
    assert cards["Redis 缓存穿透怎么解决？"].badge == "2 个独立来源" and cards["Redis 缓存穿透怎么解决？"].links[0] == "美团一面 · 正文第 1 行"


def search_brute(docs, queries, k, pattern=None):
    import hashlib
    import math
    import re
    from collections import Counter

    def terms(t):
        c = re.sub(r"[^一-鿿]", "", t.lower())
        return re.findall(r"[a-z0-9+#.]{2,}", t.lower()) + [c[i : i + n] for n in (2, 3) for i in range(len(c) - n + 1)]

    dim = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") % 1024
    vec = lambda t: Counter(map(dim, terms(t)))
    out = []
    for qi, q in queries:
        lists = []
        for kind in ("g", "v"):
            scored = []
            for i, h, _ in docs:
                if kind == "g":
                    a = set(terms(q))
                    s = len(a & set(terms(h))) / max(1, len(a)) + (q.lower() in h.lower()) + bool(pattern and re.search(pattern, h, re.I))
                else:
                    a, b = vec(q), vec(h)
                    size = lambda c: math.sqrt(sum(x * x for x in c.values()))
                    s = sum(x * b[d] for d, x in a.items()) / (size(a) * size(b)) if a and b else 0
                scored.append((s, i))
            lists.append({i: r for r, (s, i) in enumerate(sorted(scored, reverse=True), 1) if s > 0})
        g, v = lists
        quality = {i: x for i, _, x in docs}
        score = {i: sum(1 / (60 + m[i]) for m in lists if i in m) for i in [*g, *[i for i in v if i not in g]]}
        order = sorted(score, key=lambda i: (-score[i], -quality[i], i not in g, g.get(i, v.get(i))))
        out += [(qi, i, p) for p, i in enumerate(order[: max(1, k)], 1)]
    return out


@pytest.mark.parametrize("k, pattern", [(3, None), (20, "w1|漢字")])
def test_search_equals_brute_force(spark, k, pattern):
    from lodestone.operators.search import hybrid_search

    rng = random.Random(k)
    words = [f"w{i}" for i in range(12)] + ["漢字", "文書", "c++", "a"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice([0.5, 0.9])) for i in range(150)]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(0, 3)))) for i in range(6)]
    got = hybrid_search(spark.createDataFrame(docs, "ordinal long, haystack string, quality_score double"), spark.createDataFrame(queries, "query_id long, query string"), top_k=k, grep_pattern=pattern)
    assert sorted((r.query_id, r.ordinal, r.place) for r in got.collect()) == sorted(search_brute(docs, queries, k, pattern))


def test_runs(spark, tmp_path):
    events = [("r", "a", "failed", 1, "boom"), ("r", "a", "done", 2, ""), ("r", "b", "done", 3, ""), ("r", "b", "failed", 4, "e" * 2000), ("r", "", "finish", 5, ""), ("s", "a", "done", 1, ""), ("s", "", "finish", 2, ""), ("t", "a", "done", 1, "")]
    df = spark.createDataFrame([(r, i, k, t, t, e) for r, i, k, t, e in events], "run_id string, item string, kind string, ts long, event_id long, error string")
    items = {(r.run_id, r.item): r for r in state.items(df).collect()}
    assert items["r", "b"].done and items["r", "b"].failed and len(items["r", "b"].error) == 1000 and not items["r", "a"].failed
    assert {r.run_id: r.status for r in state.replay(df).collect()} == {"r": "partial", "s": "complete", "t": "running"}
    wanted = spark.createDataFrame([("r", "a"), ("r", "c"), ("s", "a")], "run_id string, item string")
    assert [tuple(r) for r in state.pending(wanted, df).collect()] == [("r", "c")]
    assert {r.run_id: r.all_done for r in state.all_done(wanted, df).collect()} == {"r": False, "s": True}
    runs = spark.createDataFrame([("1", "f", "partial", "2026-01-01"), ("2", "f", "running", "2026-01-02"), ("3", "f", "complete", "2026-01-03")], "run_id string, fingerprint string, status string, updated_at string")
    assert state.open_run(runs, "f").first().run_id == "2"
    assert state.open_run(runs, "f", resume=False).count() == 0
    assert state.open_run(runs, "f", run_id="3").count() == 1
    with pytest.raises(Exception, match="other parameters"):
        state.open_run(runs, "g", run_id="3").collect()
    (tmp_path / "a.json").write_text(json.dumps({"run_id": "1", "status": "partial", "updated_at": "x", "completed_items": ["k"], "failures": {"u": "e"}, "spec": {"job": "j"}}))
    (tmp_path / "b.json").write_text("{broken")
    (r,) = state.newest(readers.read_runs(spark, str(tmp_path)), by="modified").collect()
    assert (r.run_id, r.completed_items, r.failures) == ("1", ["k"], {"u": "e"})


def test_readers(spark, tmp_path):
    (tmp_path / "seed.json").write_text(json.dumps([{"platform": "x搜索索引", "title": "t", "url": "u", "text": "b"}, {"platform": "p", "title": "t", "url": "v", "text": "b", "confidence": "A"}]))
    a, b = readers.read_seed(spark, str(tmp_path / "seed.json")).orderBy("ordinal").collect()
    assert (a.source_type, a.is_complete, a.confidence, b.source_type, b.confidence) == ("indexed", False, "B", "direct", "A")
    (tmp_path / "bad.json").write_text(json.dumps([{"platform": "p", "title": "t"}]))
    with pytest.raises(Exception, match="lacks"):
        readers.read_seed(spark, str(tmp_path / "bad.json")).collect()
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "1.json").write_text(json.dumps({"platform": "p", "title": "t", "url": "u", "text": "b"}))
    (raw / "2.json").write_text("{nope")
    good, rejects = readers.read_raw(spark, str(raw))
    assert good.count() == 1 and rejects.count() == 1
    (tmp_path / "urls.txt").write_text("# no\n\n https://a.test \n  #x\nhttps://b.test\n")
    assert [r.url for r in readers.read_urls(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a.test", "https://b.test"]
    assert one(spark, readers.keywords("j", "e"), j=" 后端 ", e="") == ["后端 面经", "后端 一面", "后端 面试题"]
    assert one(spark, readers.keywords("j", "e"), j="x", e=" b, a ,b,,") == ["b", "a"]
    union = readers.union_library(readers.read_seed(spark, str(tmp_path / "seed.json")), good)
    assert [r.url for r in union.orderBy("ordinal").collect()] == ["u", "v", "u"]


def test_notes(spark):
    body = "推荐 标题\n标题\n猜你想搜\n导航\n标题\n正文内容第一行足够长足够长足够长\n第二行\n共 12 条评论\n评论"
    got = one(spark, notes.note_text("b", "t", "d"), b=body, t="标题", d="")
    assert got == "标题\n正文内容第一行足够长足够长足够长\n第二行"
    assert one(spark, notes.note_text("b", "t", "d"), b="短", t="标题", d="描" * 40) == "描" * 40
    card = json.dumps({"image_list": [{"url_default": "", "url": "http://a", "info_list": [{"url": "http://z"}]}, {"info_list": [{"url": "x"}, {"url": "http://b"}]}, {"url": "http://a"}]})
    assert one(spark, notes.image_urls(notes.parse_card("c")), c=card) == ["http://a", "http://b"]
    assert one(spark, notes.image_urls(notes.parse_card("c")), c=json.dumps({"cover": {"url_pre": "https://c"}})) == ["https://c"]
    payload = json.dumps({"a": [{"id": "n", "image_list": [{"url": "http://1"}]}], "b": {"note_id": "n", "image_list": [{"url": "http://1"}, {"url": "http://2"}]}})
    assert one(spark, notes.detail_image_urls(F.col("p"), F.col("n")), p=payload, n="n") == ["http://1", "http://2"]
    responses = spark.createDataFrame([(1, json.dumps({"data": {"items": [{"id": "1", "xsec_token": "", "note_card": {}}, {"id": "1", "xsec_token": "t1", "note_card": {"x": 1}}]}})), (2, json.dumps({"data": {"items": [{"id": "1", "xsec_token": "t2"}]}}))], "ordinal long, payload string")
    assert [(r.id, r.xsec_token) for r in notes.search_items(responses).collect()] == [("1", "t1")]
    pages = spark.createDataFrame([([(1, [("a", 0.9), ("b", 0.5)]), (2, [("c", 0.1)]), (3, [(" d ", 0.6)])],)], "p array<struct<page int, lines array<struct<text string, score double>>>>")
    assert pages.select(notes.ocr_text("p").alias("x")).first().x == "[图片OCR 第1页]\na\n[图片OCR 第3页]\nd"


def test_html(spark):
    page = "<html><head><title>(3 条消息) 题目&amp;答</title></head><body><nav>x</nav><div class='a post-content'>正文<div>里面</div></div><article>短</article><script>no</script></body></html>"
    assert html.main_text_of("www.nowcoder.com", page) == "正文\n里面"
    assert html.main_text_of("www.test", page) == "短"
    assert html.main_text_of("zhihu.com", page).startswith("x")
    rows = spark.createDataFrame([(1, "https://zhihu.com/a", page), (2, "https://b.test/c", "<body>请完成安全验证</body>"), (3, "https://b.test/d", "<article>" + "长" * 90 + "</article>"), (4, "https://c.test", "<main>短</main>")], "page_id long, url string, html string")
    got = {r.ordinal: r for r in html.rejected(html.page_posts(rows)).collect()}
    assert got[1].title == "题目&答" and got[1].platform == "知乎"
    assert "验证" in got[2].reason and "阻断" in got[3].reason and got[4].reason == "正文不足 80 字"


def test_urls_and_blocks(spark):
    assert one(spark, T.search_url("k"), k="后端 a/b*~") == "https://www.xiaohongshu.com/search_result?keyword=%E5%90%8E%E7%AB%AF%20a/b%2A~&type=51"
    assert one(spark, T.note_url("i", "t"), i="n", t="a b=") == "https://www.xiaohongshu.com/explore/n?xsec_token=a+b%3D&xsec_source=pc_search"
    assert one(spark, C.page_blocked("t"), t="扫码登录 CAPTCHA").startswith("检测到验证码")
    assert one(spark, C.page_blocked("t"), t="ok") is None
    assert one(spark, C.profile_key("u"), u="https://mp.weixin.qq.com/s/1") == "weixin"
    assert one(spark, C.platform_label("h"), h="Other.test") == "other.test"
    assert one(spark, C.note_id("u"), u="https://x.test/explore/abc?x=1") == "abc"
    done = one(spark, C.completeness("t", "e", "d", "o"), t="[图片OCR 第1页]\n[图片OCR 第2页]", e=2, d=2, o=True)
    assert (done.is_complete, done.collection_depth, done.confidence, done.ocr_page_count) == (True, "deep", "C", 2)
    assert one(spark, C.regex_hit("t", "ÉA"), t="xéay") and one(spark, C.phrase_hit("t", "q"), t="AbC", q="bc")


def test_stream_rebuild(spark, tmp_path):
    from lodestone.streaming import rebuild

    land = tmp_path / "land"
    land.mkdir()
    args = [str(tmp_path / x) for x in ("land", "raw", "lib", "ck")]
    put = lambda n, text: (land / f"{n}.json").write_text(json.dumps({"platform": "p", "title": "t", "url": f"https://zhihu.com/{n[0]}", "text": text}))
    put("a1", "1. Redis 缓存穿透怎么解决？")
    rebuild.start(spark, *args).awaitTermination()
    assert spark.read.parquet(args[2] + "/questions").count() == 1
    put("b1", "1. Redis 缓存穿透怎么解决？")
    put("a2", "1. 一个更长的版本为什么会替换前者？")
    rebuild.start(spark, *args).awaitTermination()
    got = {r.question: r.frequency for r in spark.read.parquet(args[2] + "/questions").collect()}
    assert got == {"Redis 缓存穿透怎么解决？": 1, "一个更长的版本为什么会替换前者？": 1}


def test_cli(spark, tmp_path, capsys):
    from lodestone import cli

    (tmp_path / "seed.json").write_text(json.dumps([{"platform": "p", "title": "t", "url": "u", "text": "1. Redis 缓存穿透怎么解决？"}]))
    assert cli.main(["build", "--seed", str(tmp_path / "seed.json"), "--database", str(tmp_path / "lib"), "--output", str(tmp_path / "out.html")], spark) == 0
    assert '"questions": 1' in capsys.readouterr().out
    cli.main(["search", "缓存", "--database", str(tmp_path / "lib")], spark)
    assert "缓存穿透" in capsys.readouterr().out


def test_latin_pack_is_only_data():
    assert LATIN.block == DEFAULT.block and set(LATIN.__dataclass_fields__) == set(DEFAULT.__dataclass_fields__)


def test_dense_queries_travel_in_bounded_blocks(spark, monkeypatch):
    from lodestone.operators import search

    vectors = [(i, [float(i % 7), float(i % 5) - 2]) for i in range(200)]
    docs = spark.createDataFrame(vectors[:30], "ordinal long, v array<double>")
    asked = spark.createDataFrame(vectors, "query_id long, v array<double>")
    sent, broadcast = [], search.F.broadcast
    monkeypatch.setattr(search.F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    got = search.dense(docs, asked, chunk=40)
    monkeypatch.undo()
    sizes = [len(r.given) for df in sent for r in df.collect()]
    assert sum(sizes) == 200 and max(sizes) <= 40
    expected = sorted((q, o, a[0] * b[0] + a[1] * b[1]) for q, a in vectors for o, b in vectors[:30])
    assert sorted((r.query_id, r.ordinal, r.score) for r in got.collect()) == expected
