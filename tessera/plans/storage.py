"""Reliable checkpoints in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own only where that is unset and the master is local. On a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def checkpoint(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``written`` makes within are dropped at the end; what is built on them must be written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for table in _SCRATCH.pop():
            remove(table)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: as a checkpoint, but its size is known to the planner. ``remove`` drops it."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


def tasks(spark: SparkSession) -> int:
    """Parts that rows are dealt to where each part has slow work: no fewer than cores."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def dealt_alike(spark: SparkSession) -> Iterator[None]:
    """Joins whose sides are both dealt by some of their keys move neither. Holds for what is written within."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def apart(spark: SparkSession) -> Iterator[None]:
    """Tables of one partition each are as many tasks in a union, and not one. Holds for what is written within."""
    key = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def bucketed(df: DataFrame, name: str, *keys: str, buckets: int | None = None, codec: str = "snappy") -> DataFrame:
    """``written``, in buckets by the keys: joins and sums by them move only the other side.

    The buckets are a table of a name of its own at a path in the shared folder; its
    size is stored with it, so small ones may still be broadcast. ``remove`` drops both.
    """
    spark = df.sparkSession
    number = uuid.uuid4().hex
    path, table = f"{checkpoint_dir(spark)}/{name}-{number}", f"{name}_{number}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.format("parquet").option("path", path).option("compression", codec).bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS NOSCAN")
    out = spark.table(table)
    out._written, out._table = path, table
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


def remove(table: DataFrame) -> None:
    """Drop a table that ``written`` or ``bucketed`` made and nothing reads any more."""
    if hasattr(table, "_table"):
        table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._table}")
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table._written)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
