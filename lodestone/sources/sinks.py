"""Sinks: post snapshots, keyed raw snapshots, the library's four tables, the HTML report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import post_identity, short_id
from ..plans.library import Library, final_order
from ..rules import DEFAULT, RulePack
from ..schemas import POST, RUN, SCHEMA_VERSION

QUESTION_COLUMNS = ["question_id", "question", "normalized", "topic", "frequency", "confidence", "quality_score", "companies", "platforms", "businesses"]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def swap(spark: SparkSession, staged: str, final: str) -> None:
    """Put a wholly written folder in place of the old one by renames."""
    fs, new = _fs(spark, staged)
    _, old = _fs(spark, final)
    _, aside = _fs(spark, f"{final}.old-{uuid.uuid4().hex}")
    if fs.exists(old):
        fs.rename(old, aside)
    if not fs.rename(new, old):
        raise OSError(f"could not move {staged} to {final}")
    fs.delete(aside, True)


def save_posts(posts: DataFrame, path: str) -> None:
    """Snapshot of posts as JSON, replaced at once."""
    staged = f"{path}.tmp-{uuid.uuid4().hex}"
    posts.select(*POST.fieldNames()).write.json(staged)
    swap(posts.sparkSession, staged, path)


def raw_key(pack: RulePack = DEFAULT):
    """Key of a post in the raw store: 12 hex digits of its identity."""
    return short_id(post_identity("platform", "url", "title", pack), 12)


def upsert_raw(posts: DataFrame, path: str, pack: RulePack = DEFAULT) -> None:
    """Keyed snapshot store: the later post of an identity replaces the earlier."""
    spark = posts.sparkSession
    new = posts.select(*POST.fieldNames(), F.lit(1).alias("_age"))
    fs, p = _fs(spark, path)
    rows = new.unionByName(spark.read.schema(POST).parquet(path).withColumn("_age", F.lit(0))) if fs.exists(p) else new
    newest = rows.groupBy(raw_key(pack).alias("_key")).agg(F.max_by(F.struct(*POST.fieldNames()), F.struct("_age", "collected_at")).alias("p"))
    staged = f"{path}.tmp-{uuid.uuid4().hex}"
    newest.select("p.*").write.parquet(staged)
    swap(spark, staged, path)


def save_runs(runs: DataFrame, path: str) -> None:
    """Run states (columns of RUN) as JSON lines, replaced at once."""
    staged = f"{path}.tmp-{uuid.uuid4().hex}"
    runs.select(*RUN.fieldNames()).write.json(staged)
    swap(runs.sparkSession, staged, path)


def number_rows(rows: DataFrame, order: list, path: str) -> DataFrame:
    """``rows`` with ordinal, their 0-based place in a total order, without one task that sees all.

    Sorted ranges are written to ``path`` first, so that places within ranges and sizes of ranges agree.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", at).write.parquet(path)
    kept = spark.read.parquet(path).withColumn("_p", F.shiftright("_m", 33)).withColumn("_r", F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m")
    # one row with one entry a range
    sizes = kept.groupBy("_p").agg(F.count("*").alias("n")).groupBy().agg(F.collect_list(F.struct("_p", "n")).alias("_sizes"))
    before = F.aggregate(F.filter("_sizes", lambda s: s["_p"] < F.col("_p")), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return kept.join(F.broadcast(sizes)).withColumn("ordinal", before + F.col("_r")).drop("_p", "_r", "_sizes")


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def save_library(library: Library, path: str) -> None:
    """posts, questions, question_sources and meta as Parquet, written aside and moved into place together."""
    spark = library.posts.sparkSession
    staged = f"{path}.tmp-{uuid.uuid4().hex}"
    library.posts.select("source_id", *POST.fieldNames(), "ordinal").write.parquet(f"{staged}/posts")
    ranked = f"{path}.ranked-{uuid.uuid4().hex}"
    number_rows(library.questions, final_order(), ranked).write.parquet(f"{staged}/library")
    _drop(spark, ranked)
    kept = spark.read.parquet(f"{staged}/library")
    kept.select(*QUESTION_COLUMNS).sort("topic").write.parquet(f"{staged}/questions")
    Library(library.posts, library.rows, kept).links.write.parquet(f"{staged}/question_sources")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    spark.range(1).select(F.explode(F.array(F.struct(F.lit("schema_version").alias("key"), F.lit(SCHEMA_VERSION).alias("value")), F.struct(F.lit("generated_at").alias("key"), now.alias("value")))).alias("m")).select("m.*").write.parquet(f"{staged}/meta")
    check_library(spark, staged)
    swap(spark, staged, path)


def check_library(spark: SparkSession, path: str) -> None:
    """Keys are unique and links point at posts and questions; else ValueError."""
    t = {n: spark.read.parquet(f"{path}/{n}") for n in ("posts", "questions", "question_sources")}
    for name, key in (("posts", ["source_id"]), ("questions", ["question_id"]), ("questions", ["normalized"]), ("question_sources", ["question_id", "source_id"])):
        if t[name].groupBy(*key).count().where("count > 1").head(1):
            raise ValueError(f"{name} repeats {key}")
    for name, key in (("posts", "source_id"), ("questions", "question_id")):
        if t["question_sources"].join(t[name], key, "left_anti").head(1):
            raise ValueError(f"question_sources points at a missing row of {name}")


def load_library(spark: SparkSession, path: str) -> Library:
    posts = spark.read.parquet(f"{path}/posts")
    return Library(posts, None, spark.read.parquet(f"{path}/library"))


TEMPLATE = """<!doctype html><html lang="zh-CN"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width"><title>Question library</title>
<style>
body{font-family:sans-serif;max-width:72em;margin:auto;padding:1em;color:#222}
nav{display:flex;flex-wrap:wrap;gap:.5em;position:sticky;top:0;background:#fff;padding:.5em 0}nav input{flex:1 1 16em}
article{border:1px solid #ccc;border-radius:4px;margin:.5em 0;padding:.6em}mark{background:#eef;padding:.1em .4em;margin-right:.4em;font-size:.85em}
small,footer{color:#666}p.text{max-height:6em;overflow:hidden;white-space:pre-line}a{color:#245}
</style></head><body><h1>Question library</h1><p id="counts"></p>
<nav><input id="text" type="search" placeholder="search"><select id="company"></select><select id="topic"></select><select id="platform"></select>
<select id="quality"><option value="">any quality</option><option value="high">score of 0.70 or more</option><option value="verified">two sources or more</option></select>
<select id="view"><option value="questions">questions</option><option value="posts">sources</option></select></nav>
<p id="shown"></p><main id="list"></main><footer>GENERATED_AT</footer>
<script>
const DATA = PAYLOAD;
const at = id => document.getElementById(id);
const make = (parent, tag, text, set) => { const e = Object.assign(document.createElement(tag), set || {}); if (text != null) e.textContent = text; parent.append(e); return e; };
const FIELDS = {company: [q => q.companies, p => [p.company]], topic: [q => [q.topic], null], platform: [q => q.platforms, p => [p.platform]]};
for (const [id, [ofQuestion]] of Object.entries(FIELDS)) {
  const found = new Set(DATA.questions.flatMap(ofQuestion).filter(v => v));
  make(at(id), "option", "any " + id, {value: ""});
  for (const v of Array.from(found).sort(new Intl.Collator("zh-CN").compare)) make(at(id), "option", v, {value: v});
}
const GOOD = {"": () => true, high: q => (q.quality_score || 0) >= 0.7, verified: q => q.independent_source_count >= 2};
const where = e => !e ? "" : e.type === "ocr" && e.page ? " · 图片第 " + e.page + " 页" : e.line ? " · 正文第 " + e.line + " 行" : "";
function keep(row, kind) {
  for (const [id, of] of Object.entries(FIELDS)) { const want = at(id).value; if (want && of[kind] && !of[kind](row).includes(want)) return false; }
  const text = at("text").value.trim().toLowerCase();
  return (kind === 1 || GOOD[at("quality").value](row)) && (!text || JSON.stringify(row).toLowerCase().includes(text));
}
function question(q) {
  const card = make(at("list"), "article");
  for (const c of q.companies.slice(0, 4)) make(card, "mark", c);
  make(card, "mark", q.topic); make(card, "mark", "质量 " + Math.round((q.quality_score || 0) * 100));
  if (q.frequency > 1) make(card, "small", q.frequency + " 个独立来源");
  make(card, "h3", q.question);
  for (const s of q.sources.slice(0, 3)) {
    const line = make(card, "div"), from = s.source;
    make(line, "a", from.title + where(from.evidence), {href: from.url, target: "_blank", rel: "noopener", title: (from.evidence || {}).excerpt || ""});
  }
  make(card, "small", q.platforms.join(" / "));
}
function post(p) {
  const card = make(at("list"), "article");
  for (const v of [p.company, p.business, "可信度 " + p.confidence, (p.collection_depth || "text") + " · " + (p.is_complete ? "完整" : "部分")]) make(card, "mark", v);
  make(make(card, "h3"), "a", p.title, {href: p.url, target: "_blank", rel: "noopener"});
  make(card, "p", p.text, {className: "text"});
  make(card, "small", p.platform + " · " + (p.date || "日期未记录"));
}
function show() {
  const kind = at("view").value === "posts" ? 1 : 0, all = kind ? DATA.posts : DATA.questions, rows = all.filter(r => keep(r, kind));
  at("list").replaceChildren();
  rows.forEach(kind ? post : question);
  at("shown").textContent = rows.length + " / " + all.length;
}
const platforms = new Set(DATA.posts.map(p => p.platform).filter(v => v)).size, high = DATA.posts.filter(p => p.confidence === "A").length;
at("counts").textContent = [DATA.questions.length + " questions", DATA.posts.length + " sources", platforms + " platforms", high + " A sources"].join(" · ");
for (const id of ["company", "topic", "platform", "quality", "view"]) at(id).addEventListener("change", show);
at("text").addEventListener("input", show);
show();
</script></body></html>"""


def render_html(library: Library) -> str:
    """Stand-alone report of a small library: the one sink that gathers its rows, as a page must hold them."""
    from datetime import datetime

    gather = lambda df: "[" + ",".join(df.toJSON().collect()) + "]"
    from ..operators.aggregate import in_order

    posts, questions = gather(library.posts.select(*POST.fieldNames())), gather(in_order(library.questions).drop("seq", "ordinal"))
    payload = ('{"posts":' + posts + ',"questions":' + questions + "}").replace("</", "<\\/")
    return TEMPLATE.replace("GENERATED_AT", datetime.now().strftime("%Y-%m-%d %H:%M")).replace("PAYLOAD", payload)
