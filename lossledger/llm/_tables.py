"""Shared folder, checked broadcasts and small helpers."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side joined by broadcast has at most so many rows (of a few numbers each); beyond that Spark shuffles it.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; in tests, where it is unset, a folder in the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    return where.rstrip("/") if where else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lossledger-shared"


#: Makes Spark delete a statement's shuffle files when it has ended, rather than when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, clean: bool = False) -> DataFrame:
    """The DataFrame written to the shared folder and read again: cuts lineage and survives lost executors. clean: its shuffle files go at once.

    The table is deleted by discard(), or when the session ends: results that are still to be computed read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, clean or before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    where, fs = _hadoop(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of materialise() that nothing reads any more."""
    files = df.inputFiles()
    if files:
        where, fs = _hadoop(df.sparkSession, files[0])
        fs.delete(where.getParent(), True)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it has at most BROADCAST_ROWS rows; else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


#: 64-bit slots of a bit map: 8 MB, whatever it marks.
SLOTS = 1 << 20


def bits(df: DataFrame, column: str) -> DataFrame:
    """(slot, bits): the bit map of a column of 64-bit hashes, SLOTS rows at most. False hits grow with the values; none is missed."""
    h = F.col(column)
    return df.groupBy(h.bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, 20) & 63 as int))")).alias("bits"))


def bit_map(df: DataFrame, column: str) -> np.ndarray:
    out = np.zeros(SLOTS, np.uint64)
    t = bits(df, column).toArrow()
    out[t["slot"].to_numpy()] = t["bits"].to_numpy().view(np.uint64)
    return out


def trim() -> None:
    """Gives the memory that a Python worker has freed back to the system: it waits for other tasks beside an executor that needs it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of these has, letters' case aside."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def buckets(spark: SparkSession) -> int:
    """Partitions for explicit repartitioning: what the session sets for its shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
