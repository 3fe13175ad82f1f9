"""Landed snapshots as DataFrames: seeds, raw snapshot folders, URL lists, keywords, run files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..rules import DEFAULT, RulePack
from ..schemas import DEFAULTS, POST, REQUIRED, RUN


def _with_defaults(df: DataFrame) -> DataFrame:
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()}
    return df.withColumns(filled | {"collected_at": F.coalesce("collected_at", now)})


def _whole(df: DataFrame):
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in REQUIRED])


def read_seed(spark: SparkSession, path: str, pack: RulePack = DEFAULT) -> DataFrame:
    """Posts of a JSON array, with ordinal. A post without a required field fails the read."""
    rows = spark.read.schema(POST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    lacking = F.when(~_whole(rows), F.raise_error(F.lit("a post lacks platform, title, url or text")))
    rows = rows.where(F.coalesce(lacking.cast("boolean"), F.lit(True)))
    indexed = F.col("platform").contains(pack.index_platform)
    rows = _with_defaults(rows)
    rows = rows.withColumn("source_type", F.when(indexed, "indexed").otherwise(F.col("source_type"))).withColumn("is_complete", ~indexed & F.col("is_complete"))
    return rows.withColumn("ordinal", F.monotonically_increasing_id())


def read_raw(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(posts, rejects) of a folder with one JSON object a file; corrupt or lacking ones are rejects."""
    schema = T.StructType([*POST.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    good = F.col("_corrupt_record").isNull() & _whole(rows)
    posts = _with_defaults(rows.where(good).drop("_corrupt_record")).withColumn("ordinal", F.monotonically_increasing_id())
    return posts.drop("file"), rows.where(~good).select("file", "_corrupt_record")


def union_library(*parts: DataFrame) -> DataFrame:
    """Libraries one after the other: ordinals stay in that order."""
    ranked = [p.select(*POST.fieldNames(), F.struct(F.lit(k).alias("source_rank"), F.col("ordinal")).alias("ordinal")) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, ranked)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a list file without blank and # lines."""
    rows = spark.read.text(path).select(strip("value").alias("url"))
    return rows.where((F.col("url") != "") & ~F.col("url").startswith("#"))


def keywords(job, explicit):
    """Column: explicit comma list, trimmed and distinct in order, else three phrases of the job."""
    job, explicit = (F.col(x) if isinstance(x, str) else x for x in (job, explicit))
    explicit, job = F.coalesce(explicit, F.lit("")), strip(F.coalesce(job, F.lit("")))
    given = F.array_distinct(F.filter(F.transform(F.split(explicit, ","), lambda x: strip(x)), lambda x: x != ""))
    made = F.when(job != "", F.array(*[F.concat(job, F.lit(s)) for s in (" 面经", " 一面", " 面试题")])).otherwise(F.array().cast("array<string>"))
    return F.when(strip(explicit) != "", given).otherwise(made)


def read_runs(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Run files with their modification time, one run a file or (``lines``) one a line; unreadable ones are dropped."""
    schema = T.StructType([*RUN.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(folder)
    rows = rows.withColumn("modified", F.col("_metadata.file_modification_time"))
    return rows.where(F.col("_corrupt_record").isNull() & F.col("run_id").isNotNull()).drop("_corrupt_record")
