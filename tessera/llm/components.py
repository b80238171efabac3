"""Connected components of a link table, by alternating large-star and small-star steps.

Each task first reduces its own links to a spanning forest (links within one task
need no shuffle), then hooks and contracts with partial aggregations and joins.
Nothing is gathered on the driver but one count and checksum per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Workspace

#: Links that a task holds at once while it looks for a spanning forest.
FOREST = 200_000


def forest(links: DataFrame) -> DataFrame:
    """u, v rows with the same components as ``links``: per block of a task's rows, each node with its block's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = up[p]
                x = up[x]
            return x

        def out() -> pa.RecordBatch:
            rows = [(x, root(x)) for x in list(up)]
            rows = [r for r in rows if r[0] != r[1]]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["u", "v"])

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rx, ry = root(x), root(y)
                if rx < ry:
                    up[ry] = rx
                elif ry < rx:
                    up[rx] = ry
            if len(up) > 2 * FOREST:  # more nodes than FOREST links have
                yield out()
        if up:
            yield out()

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def _large(e: DataFrame) -> DataFrame:
    sym = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(ws: Workspace, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, comp (the least node of its component) for every node of ``links`` (long columns u, v)."""
    e = ws.write(forest(links.where("u <> v")), "links")
    if e.count() <= FOREST:  # what one block holds is solved in one task of that bounded size
        whole = ws.write(forest(e.coalesce(1)), "links")
        ws.drop(e)
        return _with_roots(whole)
    last = None
    for _ in range(max_rounds):
        new = ws.write(_small(_large(e)), "links")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        ws.drop(e)
        e = new
        if state == last or not state[0]:
            break
        last = state
    else:
        raise RuntimeError("components did not converge")
    return _with_roots(e)


def _with_roots(e: DataFrame) -> DataFrame:
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
