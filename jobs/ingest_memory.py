"""Keep the memory graph of a growing set of dialogues.

    spark-submit jobs/ingest_memory.py --turns DIR_OR_PATTERN --out DIR --checkpoint DIR [--config FILE]

Reads turns (conv_id, turn, role, text; Parquet files that are added over time) as a
file stream with a checkpoint: a run takes the files that no run before it has taken
and ends. Of each batch

* its turns go to ``out/turns/batch=<n>``, a folder that a replay writes over;
* the dialogues it touches are built anew from all their turns: chunks, a vector a
  chunk, edges between chunks of one dialogue that are alike;
* the parts of ``out/memory`` that hold them are replaced (dynamic overwrite), with
  the rows of the dialogues that were not touched carried over as they are.

``out/memory`` is partitioned by part (conv_id modulo ``parts``) and has a row for every
dialogue (its turns), node (a chunk) and edge. A part that is replaced has at least the
row of a dialogue, so none can keep rows of an earlier state.

A batch that fails at any point is taken again by the next run, with the same rows. Of
a turn that comes twice the later batch counts, within a batch the greater row. Turns
without a conv_id or number belong to no dialogue and are left out; blank ones are
counted but are in no chunk. Dialogues may be of any length: turns are numbered by a
range sort, chunks are compared block against block.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, Observation, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import config, logger, session, stored  # noqa: E402
from tessera.operators import chunking, vectors  # noqa: E402
from tessera.operators.similarity import similar_pairs  # noqa: E402
from tessera.plans.storage import scratch, written  # noqa: E402
from tessera.sources import dialogue  # noqa: E402

NAME = "ingest_memory"
TURNS = "conv_id long, turn long, role string, text string"
MEMORY = "conv_id long, kind string, node long, other long, weight double, text string, n long, part int"
log = logger(NAME)


def memory(turns: DataFrame, rounds: int, over: float) -> DataFrame:
    """conv_id, kind, node, other, weight, text, n of whole dialogues: a row a dialogue (n: its turns), chunk (n: its code points) and edge."""
    chunks = written(chunking.turn_chunks(dialogue.from_table(turns), rounds, spread=True).select("conv_id", F.col("block").cast("long").alias("node"), "chunk"), "chunks")
    vecs = vectors.dense(vectors.hash_embedding(chunks, ["conv_id", "node"], "chunk"), ["conv_id", "node"])
    edges, report = similar_pairs(vecs, "node", "v", over, keys=["conv_id"])
    log.info("products of chunks: %s", report.first().asDict())
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda kind, node, other, weight, text, n: [F.col("conv_id"), F.lit(kind).alias("kind"), node.cast("long").alias("node"), other.cast("long").alias("other"), weight.alias("weight"), text.alias("text"), n.cast("long").alias("n")]
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("c")).select(*row("dialogue", none("long"), none("long"), none("double"), none("string"), F.col("c")))
    nodes = chunks.select(*row("node", F.col("node"), none("long"), none("double"), F.col("chunk"), F.length("chunk")))
    return whole.unionByName(nodes).unionByName(edges.select(*row("edge", F.col("i"), F.col("j"), F.col("sim"), none("string"), none("long"))))


def add(batch: DataFrame, number: int, out: str, settings: dict) -> None:
    """One batch of turns into ``out``; doing it again leaves the same."""
    spark = batch.sparkSession
    part = F.pmod("conv_id", F.lit(settings["parts"])).cast("int").alias("part")
    seen = Observation()
    own = batch.observe(seen, F.count("*").alias("rows"), F.count(F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), 1)).alias("left_out"))
    own.where("conv_id is not null and turn is not null").select("*", part).write.mode("overwrite").partitionBy("part").parquet(f"{out}/turns/batch={number}")
    log.info("batch %s: read %s", number, seen.get)

    with scratch():
        history = spark.read.schema(f"{TURNS}, batch long, part int").parquet(f"{out}/turns").where(F.col("batch") <= number)
        touched = written(history.where(F.col("batch") == number).select("conv_id", "part").distinct(), "touched")
        if touched.isEmpty():
            return
        of_them = history.join(touched, ["part", "conv_id"], "left_semi")
        latest = of_them.groupBy("conv_id", "turn").agg(F.max(F.struct("batch", "role", "text")).alias("t")).select("conv_id", "turn", "t.role", "t.text")
        built = memory(written(latest, "turns"), settings["rounds"], settings["over"]).select("*", part)
        before = stored(spark, f"{out}/memory", MEMORY, "part")
        parts = touched.select("part").distinct()
        carried = before.join(parts, "part", "left_semi").join(touched.select("conv_id"), "conv_id", "left_anti")
        new = written(carried.select(*built.columns).unionByName(built), "memory")  # read from here, so that the overwrite reads nothing it replaces
        done = Observation()
        shown = new.observe(done, F.count("*").alias("rows"), F.count(F.when(F.col("kind") == "edge", 1)).alias("edges"))
        shown.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{out}/memory")
        log.info("batch %s: wrote %s for %s dialogues", number, done.get, touched.count())


def run(spark: SparkSession, turns: str, out: str, checkpoint: str, settings: dict | None = None) -> DataFrame:
    """Take the turns that are new, then return the memory as it stands."""
    settings = config(NAME) | (settings or {})
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(turns)
    query = stream.writeStream.foreachBatch(lambda batch, number: add(batch, number, out, settings)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("took %s rows in %s batches from %s", sum(p.numInputRows for p in query.recentProgress), len([p for p in query.recentProgress if p.numInputRows]), turns)
    return stored(spark, f"{out}/memory", MEMORY, "part")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for a in ("turns", "out", "checkpoint"):
        p.add_argument(f"--{a}", required=True)
    p.add_argument("--config")
    a = p.parse_args()
    spark = session(NAME)
    try:
        run(spark, a.turns, a.out, a.checkpoint, config(NAME, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
