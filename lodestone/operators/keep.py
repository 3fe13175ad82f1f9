"""Intermediate results that one plan reads several times, and folders for what is written on the way."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_kept: list[DataFrame] = []
_made: list[tuple[SparkSession, str]] = []


def keep(df: DataFrame) -> DataFrame:
    """``df``, computed once; it spills to disk, and a lost executor's part is computed again. ``release`` lets go of it.

    A cache is found by its plan. A mark of its own keeps later plans over the same, meanwhile rewritten, paths
    from finding this one.
    """
    kept = df.withColumn("_kept", F.lit(uuid.uuid4().hex)).persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(kept)
    return kept.drop("_kept")


def release() -> None:
    """Let go of all kept results of this driver; plans over them compute them again."""
    while _kept:
        _kept.pop().unpersist()


def work_path(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share, in spark.checkpoint.dir; it goes when the driver ends.

    Only a local session without that setting, as in tests, gets a temporary folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.environ.get("LODESTONE_LOCAL_WORK")
        if not root:
            root = os.environ["LODESTONE_LOCAL_WORK"] = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, root, True)
        root = f"file://{root}"
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_delete)
    _made.append((spark, path))
    return path


def _delete() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended; the folder then stays
            return


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
