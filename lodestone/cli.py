"""Command line: collect from landed snapshots, build a library, search it, show runs."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import state
from .operators.runs import RunFile
from .plans import collect as collecting
from .plans import library as plan
from .sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("collect", help="take landed snapshots of keywords and addresses, then rebuild the library")
    c.add_argument("--job", required=True)
    c.add_argument("--keywords", default="", help="instead of the job's own keywords, with commas between")
    c.add_argument("--url-file", help="further addresses, one a line")
    c.add_argument("--limit", type=int, default=3, help="notes of a keyword")
    c.add_argument("--runs", required=True, help="folder of run files")
    c.add_argument("--run-id", help="the run to continue")
    c.add_argument("--no-resume", dest="resume", action="store_false", help="start a new run")
    b = sub.add_parser("build", help="rebuild a library from a seed and raw snapshots")
    for x in (c, b):
        x.add_argument("--seed")
        x.add_argument("--raw", required=x is c, help="folder of landed snapshots")
        x.add_argument("--database", required=True)
        x.add_argument("--output")
    s = sub.add_parser("search", help="hybrid search in a library")
    s.add_argument("query")
    s.add_argument("--database", required=True)
    s.add_argument("--top-k", type=int, default=20)
    s.add_argument("--grep", "--grep-pattern", dest="grep_pattern")
    s.add_argument("--encoder", choices=("hashing", "md5", "dense"), default="hashing")
    s.add_argument("--vectors", help="for dense: Parquet of (question_id, embedding) of a sentence encoder")
    s.add_argument("--query-vector", help="for dense: the query's embedding as a JSON list")
    s.add_argument("--json", action="store_true")
    t = sub.add_parser("status", help="newest runs")
    t.add_argument("--runs", required=True)
    t.add_argument("--json", action="store_true")
    return p


def _raw(spark: SparkSession, folder: str):
    posts, rejects = readers.read_raw(spark, folder)
    for r in rejects.select("file").limit(100).collect():
        print(f"skipped {r.file}", file=sys.stderr)
    return posts


def _rebuild(spark: SparkSession, parts: list, database: str, output: str | None) -> dict:
    sinks.save_library(plan.build(readers.union_library(*parts)), database)
    library = sinks.load_library(spark, database)
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(sinks.render_html(library))
    return {"sources": library.posts.count(), "questions": library.questions.count(), "database": database, "html": output}


def _collect(spark: SparkSession, args: argparse.Namespace) -> int:
    words = spark.range(1).select(readers.keywords(F.lit(args.job), F.lit(args.keywords)).alias("k")).first().k
    urls = [r.url for r in readers.read_urls(spark, args.url_file).collect()] if args.url_file else []
    run = RunFile.open(spark, args.runs, {"job": args.job, "keywords": words, "urls": urls, "limit": args.limit}, args.run_id, args.resume)
    print(f"run {run.run_id}", file=sys.stderr)
    landed = _raw(spark, args.raw)
    seed = [readers.read_seed(spark, args.seed)] if args.seed else []
    library = seed[0] if seed else landed.limit(0)
    taken = collecting.collect(spark, run, landed, library, words, urls, args.limit)
    out = _rebuild(spark, [*seed, taken], args.database, args.output)
    run.finish()
    print(json.dumps({"run_id": run.run_id, "status": run.state["status"]} | out, ensure_ascii=False))
    return 0


def _search(spark: SparkSession, args: argparse.Namespace) -> int:
    asked = spark.createDataFrame([(0, args.query)], "query_id long, query string")
    library = sinks.load_library(spark, args.database)
    if args.encoder == "dense":
        if not (args.vectors and args.query_vector):
            raise SystemExit("--encoder dense needs --vectors and --query-vector")
        library.questions = library.questions.join(spark.read.parquet(args.vectors).select("question_id", "embedding"), "question_id")
        asked = asked.withColumn("embedding", F.array(*[F.lit(float(x)) for x in json.loads(args.query_vector)]))
    encoder = "blake2b" if args.encoder == "hashing" else args.encoder
    found = plan.search_library(library, asked, top_k=args.top_k, grep_pattern=args.grep_pattern, encoder=encoder)
    rows = [json.loads(x) for x in found.withColumn("recall", F.struct("grep", "vector")).drop("query_id", "ordinal", "grep", "vector").toJSON().collect()]
    if args.json:
        print(json.dumps({"query": args.query, "count": len(rows), "results": rows}, ensure_ascii=False, indent=2))
    else:
        for r in rows:
            print(f"{r['place']:>2}. [{r['topic']}] {r['question']}  score={r['score']:.5f}")
    return 0


def _status(spark: SparkSession, args: argparse.Namespace) -> int:
    runs = state.newest(readers.read_runs(spark, args.runs), by="modified")
    rows = [json.loads(x) for x in runs.select("run_id", "status", "updated_at", "completed_items", "failures", "spec").toJSON().collect()]
    if args.json:
        print(json.dumps(rows, ensure_ascii=False, indent=2))
    else:
        for r in rows:
            print(f"{r['run_id']}  {r['status']}  {r['updated_at']}  completed={len(r.get('completed_items') or [])} failures={len(r.get('failures') or {})}")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    if args.command == "build":
        parts = [readers.read_seed(spark, args.seed)] if args.seed else []
        parts += [_raw(spark, args.raw)] if args.raw else []
        print(json.dumps(_rebuild(spark, parts, args.database, args.output), ensure_ascii=False))
        return 0
    return {"collect": _collect, "search": _search, "status": _status}[args.command](spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
