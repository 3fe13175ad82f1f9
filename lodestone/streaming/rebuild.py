"""Append, then rebuild: landed snapshots stream in, and each batch rebuilds the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.library import build
from ..rules import DEFAULT, RulePack
from ..schemas import POST
from ..sources.readers import _with_defaults, _whole
from ..sources.sinks import raw_key, save_library, upsert_raw


def start(spark: SparkSession, landing: str, raw: str, library: str, checkpoint: str, pack: RulePack = DEFAULT, threshold: float | None = 0.84, **trigger) -> StreamingQuery:
    """Stream JSON posts of ``landing`` into the keyed raw store and rebuild ``library`` from all of it.

    A replayed batch upserts the same rows and rebuilds the same library. A rebuild is needed as a longer version
    of a post replaces one whose candidates were clustered before. Clusters depend on the order of posts, which is that of
    the raw store's keys, whatever batch a post came with.
    """

    def step(batch: DataFrame, _: int) -> None:
        good = _with_defaults(batch.where(_whole(batch)))
        if not good.head(1):
            return
        upsert_raw(good, raw, pack)
        posts = spark.read.schema(POST).parquet(raw)
        # the store has no order of its own but its keys: posts are taken by them
        order = F.conv(raw_key(pack), 16, 10).cast("long")
        save_library(build(posts.withColumn("ordinal", order), pack, threshold), library)

    stream = spark.readStream.schema(POST).option("multiLine", True).json(landing)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_status(events: DataFrame) -> DataFrame:
    """Run counters over a stream of events, in update mode: marks done and failed of each run."""
    return events.groupBy("run_id").agg(F.count_if(F.col("kind") == "done").alias("done_marks"), F.count_if(F.col("kind") == "failed").alias("failed_marks"), F.max("ts").alias("updated_at"))
