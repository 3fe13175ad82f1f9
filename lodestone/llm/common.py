"""Shared helpers: table reading, the shared work folder, text columns, label splits."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: bytes of a batch that goes to Python at once; a longer text stands alone
BATCH = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ``BATCH`` bytes, unless they are set to fewer.

    By default a batch is 10,000 rows however long; with texts that is tens of MB, several times over, in each task.
    """
    now = spark.conf.get(_BYTES).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH:
        spark.conf.set(_BYTES, str(BATCH))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; the session's batches are bounded from here on."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share (spark.checkpoint.dir).

    Only a local session without that setting, as in tests, gets a temporary folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = os.environ.get("LODESTONE_LOCAL_WORK")
    if not root:
        root = tempfile.mkdtemp(prefix="lodestone-")
        os.environ["LODESTONE_LOCAL_WORK"] = root
        atexit.register(__import__("shutil").rmtree, root, True)
    return f"file://{root}"


_made: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one; it goes with ``release``, at the latest when the driver ends."""
    path = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made.append((spark, path))
    return path


def release() -> None:
    """Delete all work folders of this driver. DataFrames that still read them can't be run afterwards."""
    while _made:
        spark, path = _made.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended; the folder then stays
            return


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as remainder null."""
    return F.crc32(column.cast("string")) % mod


def shards_for(docs: DataFrame, each: int = 32 << 20) -> int:
    """Shards of a table made from ``docs``: as many as shuffle partitions, more where the input's files are larger.

    So a shard's size has a bound: what ``each`` bytes of input make. An input of unknown size has one shard a partition.
    """
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(shuffle_partitions(docs.sparkSession), -(-size // each) if size < 1 << 53 else 1)


def hash_sample(rows: DataFrame, group: str, each: int, most: int | None = None) -> DataFrame:
    """Distinct (group, h): of each group the ``each`` first by a hash, fewer where all groups together pass ``most``.

    ``rows`` has (group, h long), h a hash of what is drawn; repeated rows count once. Only as many keys as are
    wanted, and half as many again, pass the first cut, whatever the table and however often a key is repeated.
    """
    rows = rows.where(F.col(group).isNotNull())
    sizes = {r[group]: r.n for r in rows.groupBy(group).agg(F.approx_count_distinct("h").alias("n")).collect()}
    if most is not None and sizes:
        each = max(1, min(each, most // len(sizes)))
    place = F.pmod("h", F.lit(1 << 40))
    cut = {k: (1 << 40) if n <= 2 * each else int((1.5 * each + 64) / n * (1 << 40)) for k, n in sizes.items()}
    if cut:
        rows = rows.where(place < F.create_map(*[x for k, v in cut.items() for x in (F.lit(k), F.lit(v))])[F.col(group)])
    first = Window.partitionBy(group).orderBy(place, "h")
    return rows.select(group, "h").distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= each).drop("_n")


def trim() -> None:
    """Give freed memory back: workers live long and share an executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def _find_libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.malloc_trim  # noqa: B018
        return libc
    except (OSError, AttributeError):
        return None


_libc = _find_libc()


def text_slices(texts: pa.Array, limit: int = 1 << 21, rows: int | None = None, lower: bool = False):
    """Cut a string column into runs of at most ``limit`` bytes (a longer text stands alone) and ``rows`` rows.

    Yields (first row, end row, bytes as uint8, offsets from the run's start). Nulls are empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = texts.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    off, data = _buffers(arr)
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1), i + (rows or n))
        if lower:
            own, bytes_ = _buffers(pc.utf8_lower(arr.slice(i, j - i)))
            yield i, j, bytes_[own[0] : own[-1]], own - own[0]
        else:
            yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    trim()


def _buffers(arr: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    return off, np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
