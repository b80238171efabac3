"""Incremental forms: sessions from an event stream, and edges of new vectors against the stored ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import simple_edges
from tessera.operators.vectors import dot


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n: sessions that end after ``gap`` without an event (a stream or a table)."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_edges(store: str, over: float) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: joins a batch of nodes (conv_id, node, v) with the stored ones of its conversations and itself; stores both.

    Each batch has folders of its own (batch=<id>), written over if the batch is
    replayed, and is joined with those of earlier batches only: a batch that failed
    between its two writes, or ran twice, leaves the same rows.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"{store}/nodes/batch={number}"
        batch.write.mode("overwrite").parquet(own)  # read back, so that both uses see one batch
        batch = spark.read.schema(batch.schema).parquet(own)
        old = spark.read.schema(batch.schema.add("batch", "long")).option("basePath", f"{store}/nodes").parquet(f"{store}/nodes").where(F.col("batch") < number).drop("batch")
        a = batch.select("conv_id", F.col("node").alias("j"), F.col("v").alias("__b"))
        b = old.unionByName(batch).select("conv_id", F.col("node").alias("i"), F.col("v").alias("__a"))
        sims = b.join(a, "conv_id").where("i < j").select("conv_id", "i", "j", dot(F.col("__a"), F.col("__b")).alias("sim"))
        simple_edges(sims, ["conv_id"], over).write.mode("overwrite").parquet(f"{store}/edges/batch={number}")

    return add
