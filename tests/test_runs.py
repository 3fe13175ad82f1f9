"""Run files, collecting from landed snapshots, the command line, and paths of clustering and search for large inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_library import greedy, posts

from lodestone.operators import cluster, keep, search
from lodestone.operators.runs import RunFile, canonical_json, fingerprint, read_states
from lodestone.plans import collect
from lodestone.rules import DEFAULT


def test_run_file_lives_through_its_states(spark, tmp_path):
    folder, spec = str(tmp_path / "runs"), {"job": "后端", "limit": 3, "keywords": ["b", "a"]}
    assert canonical_json(spec) == '{"job":"后端","keywords":["b","a"],"limit":3}'
    run = RunFile.open(spark, folder, spec)
    run.mark_failed("x", "boom" * 1000)
    run.mark_done("y")
    run.finish()
    stored = json.loads((tmp_path / "runs" / f"{run.run_id}.json").read_text())
    assert (stored["status"], stored["completed_items"], len(stored["failures"]["x"]), stored["fingerprint"]) == ("partial", ["y"], 1000, fingerprint(spec))
    assert not list((tmp_path / "runs").glob("*.tmp"))
    # the same task goes on where it stopped; done items clear their failures
    again = RunFile.open(spark, folder, spec)
    assert again.run_id == run.run_id and again.is_done("y") and not again.is_done("x")
    again.mark_done("x")
    assert again.state["status"] == "running"
    again.finish()
    assert again.state["status"] == "complete"
    # a complete run isn't resumed, nor one of other parameters
    fresh = RunFile.open(spark, folder, spec)
    assert fresh.run_id != run.run_id
    assert RunFile.open(spark, folder, spec, resume=False).run_id not in (run.run_id, fresh.run_id)
    assert RunFile.open(spark, folder, {"job": "x"}, run_id="mine").run_id == "mine"
    assert RunFile.open(spark, folder, {"job": "x"}, run_id="mine").state["started_at"]
    with pytest.raises(ValueError):
        RunFile.open(spark, folder, {"job": "y"}, run_id="mine")
    (tmp_path / "runs" / "broken.json").write_text("{")
    assert len(read_states(spark, folder)) == 4
    assert read_states(spark, str(tmp_path / "none")) == []


def landed(spark):
    note = lambda n, word, text="1. Redis 缓存穿透怎么解决？": {"platform": DEFAULT.note_platform, "url": f"https://www.xiaohongshu.com/explore/{n}?a=1", "keyword": word, "text": text}
    rows = [note("n1", "k1"), note("n2", "k1"), note("n2", "k1"), note("n3", "k1"), note("n4", "k1"), note("n5", "k2"), {"platform": "web", "url": "https://a.test/x#part", "text": "y"}]
    return posts(spark, rows)


def test_collect_takes_first_unseen_posts_and_marks_items(spark, tmp_path):
    run = RunFile.open(spark, str(tmp_path / "runs"), {"k": 1})
    library = posts(spark, [{"platform": DEFAULT.note_platform, "url": "https://www.xiaohongshu.com/explore/n1"}])
    taken = collect.collect(spark, run, landed(spark), library, ["k1", "k3"], ["https://a.test/x", "https://a.test/gone"], 2)
    assert sorted(r.url for r in taken.collect()) == ["https://a.test/x#part", "https://www.xiaohongshu.com/explore/n2?a=1", "https://www.xiaohongshu.com/explore/n3?a=1"]
    assert set(run.state["completed_items"]) == {"xhs:note:n2", "xhs:note:n3", "xhs:keyword:k1", "web:url:https://a.test/x"}
    assert run.state["failures"] == {"xhs:keyword:k3": collect.NO_SNAPSHOT, "web:url:https://a.test/gone": collect.NO_SNAPSHOT}
    # a second run over the same state leaves out what is done
    assert collect.collect(spark, run, landed(spark), library, ["k1"], ["https://a.test/x"], 2).count() == 0
    assert run.is_done("xhs:session") and run.is_done("web:session")


def test_cli_collects_searches_and_reports(spark, tmp_path, capsys):
    from lodestone import cli

    raw = tmp_path / "raw"
    raw.mkdir()
    for k in range(3):
        post = {"platform": DEFAULT.note_platform, "title": f"t{k}", "url": f"https://www.xiaohongshu.com/explore/m{k}", "text": "1. Redis 缓存穿透怎么解决？", "keyword": "后端 面经"}
        (raw / f"{k}.json").write_text(json.dumps(post))
    (raw / "bad.json").write_text("{")
    args = ["--raw", str(raw), "--database", str(tmp_path / "lib"), "--output", str(tmp_path / "out.html")]
    assert cli.main(["collect", "--job", "后端", "--limit", "2", "--runs", str(tmp_path / "runs"), *args], spark) == 0
    out = capsys.readouterr()
    result = json.loads(out.out)
    assert (result["status"], result["sources"], result["questions"]) == ("partial", 2, 1) and "bad.json" in out.err
    cli.main(["search", "缓存", "--database", str(tmp_path / "lib")], spark)
    assert capsys.readouterr().out.startswith(" 1. [数据库与缓存] Redis 缓存穿透怎么解决？  score=")
    cli.main(["search", "缓存", "--database", str(tmp_path / "lib"), "--json"], spark)
    assert json.loads(capsys.readouterr().out)["count"] == 1
    ids = spark.read.parquet(str(tmp_path / "lib" / "questions")).select("question_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    ids.write.parquet(str(tmp_path / "vectors"))
    cli.main(["search", "无关", "--database", str(tmp_path / "lib"), "--encoder", "dense", "--vectors", str(tmp_path / "vectors"), "--query-vector", "[2, 0]"], spark)
    assert "Redis" in capsys.readouterr().out
    cli.main(["status", "--runs", str(tmp_path / "runs")], spark)
    assert "partial" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["--version"], spark)
    assert "lodestone" in capsys.readouterr().out
    page = (tmp_path / "out.html").read_text(encoding="utf-8")
    assert all(f'id="{x}"' in page for x in ("text", "company", "topic", "platform", "quality", "view", "list"))
    data = json.loads(page.split("const DATA = ")[1].split(";\nconst at")[0])
    assert len(data["questions"]) == 1 and data["questions"][0]["sources"][0]["source"]["evidence"]["line"] == 1


def test_rounds_equal_the_walk(spark):
    rng = random.Random(7)
    rows = [(f"{k:04d}", "ab" + "".join(rng.choices("cde", k=rng.randint(4, 9)))) for k in range(300)]
    first = {}
    for seq, norm in rows:
        first.setdefault(norm, seq)
    forms = spark.createDataFrame([(n, s) for n, s in first.items()], "norm string, seq string")
    expected = greedy([(s, n) for n, s in first.items()], 0.84)
    for walk in (1 << 20, 1):
        got = {r.norm: r.cluster for r in cluster.cluster_forms(forms, 0.84, walk=walk).collect()}
        assert got == expected
    keep.release()


def test_search_in_blocks_equals_search_at_once(spark):
    rng = random.Random(3)
    words = ["redis", "tcp", "缓存", "进程", "sql"]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, k=4)), 0.5, [rng.random(), rng.random()]) for k in range(40)], "ordinal long, haystack string, quality_score double, embedding array<double>")
    asked = spark.createDataFrame([(k, " ".join(rng.choices(words, k=2)), [rng.random() - 0.5, rng.random()]) for k in range(9)], "query_id long, query string, embedding array<double>")
    for encoder in ("md5", "dense"):
        found = [sorted(map(tuple, search.hybrid_search(docs, asked, top_k=5, encoder=encoder, grep_pattern="sql", chunk=c).collect())) for c in (100, 4)]
        assert found[0] == found[1] and len(found[0]) >= 9 * 4
    with pytest.raises(ValueError):
        search.hybrid_search(docs, asked, encoder="other")
