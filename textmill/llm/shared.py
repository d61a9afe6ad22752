"""Shared storage, written tables and Arrow helpers of the operators.

Every intermediate that must outlive an executor is a Parquet table or a file
in the folder that ``spark.checkpoint.dir`` names. Where that is unset, a local
master gets a folder under ``/tmp`` once; on a cluster it is an error.
"""

from __future__ import annotations

import ctypes
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.shipping import ensure_importable

#: Rows in one Arrow batch; a batch of the longest texts stays in tens of MB.
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
            sc.setCheckpointDir(f"/tmp/textmill-{uuid.uuid4().hex}")
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder in the shared one."""
    return posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, survives lost executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(url: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared URL, for workers that write or read raw bytes."""
    if "://" not in url and url.startswith("file:"):
        url = "file://" + url[len("file:") :]
    return pafs.FileSystem.from_uri(url)


def hand_back() -> None:
    """Returns freed memory to the system: a worker stays between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which keeps its own books
        pass


def by_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` over batches cut to at most ``rows`` rows.

    The batch size that Spark sends is a session setting, so batches are cut
    again in the worker; the setting itself is lowered once for the session,
    because one batch holds whole texts.
    """
    spark = df.sparkSession
    ensure_importable(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1024:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(cut(batches))
        finally:
            hand_back()

    return df.mapInArrow(run, schema)


def rows_out(columns: dict[str, tuple[pa.DataType, list]]) -> pa.RecordBatch:
    """A batch from named, typed lists."""
    return pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in columns.values()], names=list(columns))


def bounded_sample(df: DataFrame, size: int, *key: str) -> DataFrame:
    """``size`` rows at most, those of the least hashes of the key columns, ties by the columns themselves: the same rows in every run and partitioning.

    Rows over a threshold that leaves about twice as many are dropped where they
    are read, so what reaches the driver doesn't grow with the partitions.
    """
    n = df.count()
    place = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), F.pmod(F.xxhash64(*key), F.lit(1 << 40)).alias("place"))
    if n > 2 * size:
        place = place.filter(F.col("place") < int((1 << 40) * (2 * size + 200) / n))
    return place.orderBy("place", *(F.col("row").getField(k) for k in key)).limit(size).select("row.*")


#: Rows of one key from which on it is joined by a broadcast, and keys that are so at most.
HOT, HOT_KEYS = 1000, 50_000


def joined(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row per key and in ``n`` the number of ``rows`` of it; ``total`` is the sum of n.

    Keys of many rows are broadcast, which are at most ``HOT_KEYS`` by their
    number of rows; the others are joined by a shuffle in which none is dense.
    """
    limit = max(HOT, total // HOT_KEYS)
    hot = table.filter(F.col("n") > limit).drop("n")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(F.col("n") <= limit).drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)
