"""Chunkers: fixed groups of turns, greedy packing under a budget, cuts at boundaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_blank, strip, turn_line, turn_with_image
from tessera.operators.ordering import FILE_NUMBER, numbered
from tessera.plans.storage import written

LONG = 100_000  # items of a key that one task folds


def ordered_join(order: str, text: str, sep: str) -> Column:
    """The group's texts joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), sep)


def numbered_lines(lines: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """keys, context: the key's lines as one JSON object by their numbers, in the order of the numbers (2 before 10)."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.struct(x[order].cast("string"), x[text]))
    return lines.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("context"))


def turn_groups(turns: DataFrame, rounds: int = 1, spread: bool = False) -> DataFrame:
    """Turns of a session in blocks of 2 * rounds; an incomplete tail joins the block before it.

    Adds line, rn (place among the turns that aren't blank), block and glued: true
    on the first turn of a tail that joins another block. ``spread``: sessions may be of
    any length; they are numbered over all tasks (a sort and a write) and not by a window.
    """
    size = 2 * rounds
    rows = turns.where(~is_blank(F.col("text"))).withColumn("line", turn_line(F.col("speaker"), F.col("text")))
    if spread:
        rows = numbered(rows, ["conv_id", "session_ord"], ["turn_ord"])
    else:
        w = Window.partitionBy("conv_id", "session_ord")
        rows = rows.withColumn("rn", F.row_number().over(w.orderBy("turn_ord")) - 1).withColumn("n", F.count("*").over(w))
    full = F.floor(F.col("n") / size)
    block = F.least(F.floor(F.col("rn") / size), F.greatest(full - 1, F.lit(0)))
    return rows.withColumn("block", block).withColumn("glued", (full >= 1) & (F.col("rn") == full * size))


def turn_chunks(turns: DataFrame, rounds: int = 1, tail_sep: str = "", spread: bool = False) -> DataFrame:
    """conv_id, session_ord, block, chunk: lines joined by a line end, before a glued tail by ``tail_sep``."""
    g = turn_groups(turns, rounds, spread)
    lead = F.when(F.col("rn") == F.col("block") * 2 * rounds, "").when(F.col("glued"), tail_sep).otherwise("\n")
    g = g.withColumn("part", F.concat(lead, "line"))
    return g.groupBy("conv_id", "session_ord", "block").agg(ordered_join("rn", "part", "").alias("chunk"))


def turn_lines(turns: DataFrame) -> DataFrame:
    """conv_id, turn, session_ord, flat_ord, nested_ord, chunk: one chunk a turn, blank ones too, numbered in its conversation and its session."""
    flat = Window.partitionBy("conv_id").orderBy("session_ord", "turn_ord")
    nested = Window.partitionBy("conv_id", "session_ord").orderBy("turn_ord")
    chunk = turn_with_image(F.col("speaker"), F.col("text"), F.col("img_url"), F.col("query"))
    return turns.select("conv_id", F.col("turn_ord").alias("turn"), "session_ord", (F.row_number().over(flat) - 1).alias("flat_ord"), (F.row_number().over(nested) - 1).alias("nested_ord"), chunk.alias("chunk"))


def timed_groups(turns: DataFrame, rounds: int = 1) -> DataFrame:
    """conv_id, session_ord, block, rows: the session's time, then a line per turn, each led by a line end."""
    g = turn_groups(turns, rounds).withColumn("part", F.concat(F.lit("\n"), F.col("line")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rn", "part"))), lambda x: x["part"])
    return g.groupBy("conv_id", "session_ord", "block", "date_time").agg(lines.alias("lines")).select("conv_id", "session_ord", "block", F.concat(F.array("date_time"), "lines").alias("rows"))


def fold(costs: Sequence[int], budget: int, sep: int = 0) -> list[int]:
    """Chunk number of each item of an ordered list, by greedy packing.

    An item joins the current chunk if its cost and the separator's still fit; one
    over the budget stands alone; a chunk that costs nothing yet is overwritten.
    """
    out, used, chunk = [], 0, 0
    for c in costs:
        used, chunk = step(used, chunk, c, budget, sep)
        out.append(chunk)
    return out


def step(used: int, chunk: int, cost: int, budget: int, sep: int) -> tuple[int, int]:
    """What the current chunk has cost and its number, after one more item."""
    if used and used + sep + cost > budget:
        return cost, chunk + 1
    return (used + sep + cost if used else cost), chunk


def carry(costs: np.ndarray, budget: int, sep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int, int]:
    """What a run of items does to the state that greedy packing enters it with.

    (levels, used, breaks, total, fresh used, fresh breaks): with u > 0 on the way in,
    the first chunk that begins in the run begins where the sum of costs and separators
    first exceeds budget - u. ``levels`` are the sums at which that can be, ascending;
    for each, ``used`` is the state on the way out and ``breaks`` how many chunks began.
    Beyond the last level none begins and u + ``total`` goes out. Fresh: with u = 0.
    There are at most budget + 1 levels, however long the run is.
    """
    sums = np.cumsum(costs + sep)
    m = len(costs)
    loud = np.flatnonzero(costs > 0)
    ends: dict[int, tuple[int, int]] = {}  # start -> (state on the way out, chunks begun after it)

    def end(start: int) -> tuple[int, int]:
        path = []
        while start not in ends:
            k = np.searchsorted(loud, start)  # items without cost at a chunk's start are free
            if k == len(loud):
                ends[start] = (0, 0)
                break
            first = int(loud[k])
            after = max(first + 1, int(np.searchsorted(sums, budget + sums[first] - costs[first], "right")))
            if after >= m:
                ends[start] = (int(sums[-1] - sums[first] + costs[first]), 0)
                break
            path.append(start)
            start = after
        used, breaks = ends[start]
        for s in reversed(path):
            breaks += 1
            ends[s] = (used, breaks)
        return used, breaks

    last = int(np.searchsorted(sums, budget - 1, "right"))  # no state carries the first start beyond this item
    levels, at = np.unique(sums[: last + 1], return_index=True)
    out = [end(int(t)) for t in at]
    fresh = end(0)
    return levels, np.array([u for u, _ in out], np.int64), np.array([n + 1 for _, n in out], np.int64), int(sums[-1]), fresh[0], fresh[1]


def _entries(parts: DataFrame, keys: list[str], budget: int, sep: int) -> DataFrame:
    """keys, __file, __used, __chunk: the state in which each run of a key begins. parts: keys, __file, __at, __cost, keys in several files only."""
    kinds = dict(parts.dtypes)
    own = ", ".join(f"{k} {kinds[k]}" for k in keys)
    schema = f"{own}, __file string, levels array<long>, used array<long>, breaks array<long>, total long, fresh_used long, fresh_breaks long"

    def summary(g: pd.DataFrame) -> pd.DataFrame:
        costs = g.sort_values("__at")["__cost"].to_numpy(np.int64)
        return pd.DataFrame([(*g.iloc[0][[*keys, "__file"]], *carry(costs, budget, sep))], columns=[*keys, "__file", "levels", "used", "breaks", "total", "fresh_used", "fresh_breaks"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used, chunk = None, 0, 0
        for b in batches:
            column = {n: b.column(n) for n in b.schema.names}
            states = []
            for i, key in enumerate(zip(*(column[k].to_pylist() for k in keys))):
                if key != last:
                    last, used, chunk = key, 0, 0
                states.append((used, chunk))
                if used == 0:
                    used, chunk = column["fresh_used"][i].as_py(), chunk + column["fresh_breaks"][i].as_py()
                    continue
                t = int(np.searchsorted(column["levels"][i].values.to_numpy(), budget - used, "right"))
                if t == len(column["levels"][i]):
                    used += column["total"][i].as_py()
                else:
                    used, chunk = column["used"][i][t].as_py(), chunk + column["breaks"][i][t].as_py()
            yield pa.RecordBatch.from_arrays([*(column[k] for k in keys), column["__file"], *(pa.array([x[j] for x in states], pa.int64()) for j in (0, 1))], [*keys, "__file", "__used", "__chunk"])

    runs = parts.groupBy(*keys, "__file").applyInPandas(summary, schema).withColumn("__number", F.regexp_extract("__file", FILE_NUMBER, 1).cast("long"))
    return runs.repartition(*keys).sortWithinPartitions(*keys, "__number").mapInArrow(walk, f"{own}, __file string, __used long, __chunk long")


def chunk_ids(items: DataFrame, keys: list[str], order: str, cost: str, budget: int, sep: int = 0) -> DataFrame:
    """items with chunk_id, by ``fold`` over each key's items in order. Costs are whole numbers from 0 (null: 0).

    Items are sorted by range over all tasks and written, so a key of any length is cut
    into runs, a file each. A run's effect on the state of the fold is summed up without
    knowing the state (``carry``); a key's runs are then walked through, one step a run,
    and each run is folded on its own from the state it begins with. Only keys in
    several files need the walk. The fold reads a file in order and holds its state only.
    """
    ordered = written(items.orderBy(*keys, order), "ordered")
    at = ordered.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    runs = at.groupBy(*keys, "__file").agg(F.lit(1).alias("__one"))
    spread = runs.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n > 1").select(*keys, "__file")
    renamed = lambda t: t.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__file").alias("__f"), *[c for c in t.columns if c not in (*keys, "__file")])
    same = F.col("__file") == F.col("__f")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    parts = at.join(renamed(spread), same).select(*keys, "__file", "__at", F.coalesce(F.col(cost), F.lit(0)).cast("long").alias("__cost"))
    begun = written(_entries(parts, keys, budget, sep), "entries")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = at.join(renamed(begun), same, "left").select(*items.columns, "__file", "__at", zero("__used"), zero("__chunk"))

    schema = items.withColumn("chunk_id", F.lit(0)).schema
    own = [items.columns.index(c) for c in keys]
    price, width = items.columns.index(cost), len(items.columns)
    names = [*items.columns, "chunk_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used, chunk = None, 0, 0
        for b in batches:
            out = []
            for key, c, u, n in zip(zip(*(b.column(i).to_pylist() for i in (*own, width))), b.column(price).to_pylist(), b.column(width + 2).to_pylist(), b.column(width + 3).to_pylist()):
                if key != last:
                    last, used, chunk = key, u, n
                used, chunk = step(used, chunk, c or 0, budget, sep)
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(out, pa.int32())], names)

    return rows.repartition("__file").sortWithinPartitions("__file", "__at").mapInArrow(run, schema)


def _whole_keys(items: DataFrame, keys: list[str], order: str, text: str, cost: str, budget: int, sep: int, joiner: str) -> DataFrame:
    """``pack`` of keys that one task may hold: one shuffle by key, and a fold over its sorted rows that passes on a chunk as it ends."""
    kinds = dict(items.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "chunk_id int, chunk string, n_items bigint"])
    own, at, price = len(keys), len(keys) + 1, len(keys) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used, chunk, held, n = None, 0, 0, [], 0
        types, out = None, []

        def made() -> pa.RecordBatch:
            columns = list(zip(*((*k, c, t, m) for k, c, t, m in out)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.int32(), pa.string(), pa.int64()])], [*keys, "chunk_id", "chunk", "n_items"])

        for b in batches:
            types = [f.type for f in b.schema][:own]
            for *key, t, c in zip(*(b.column(i).to_pylist() for i in (*range(own), at, price))):
                if key != last or not n:
                    if n:
                        out.append((last, chunk, joiner.join(held), n))
                    last, used, chunk, held, n = key, 0, 0, [], 0
                used, after = step(used, chunk, c or 0, budget, sep)
                if after != chunk:
                    out.append((last, chunk, joiner.join(held), n))
                    chunk, held, n = after, [], 0
                n += 1
                if t is not None:
                    held.append(t)
            if out:
                yield made()
                out = []
        if n:
            out = [(last, chunk, joiner.join(held), n)]
            yield made()

    return items.repartition(*keys).sortWithinPartitions(*keys, order, text, cost).mapInArrow(run, schema)


def pack(items: DataFrame, keys: list[str], order: str, text: str, cost: str, budget: int, sep: int = 0, joiner: str = "\n") -> DataFrame:
    """keys, chunk_id, chunk, n_items: the items of each key packed in order (null costs count 0, null texts add nothing, a null key is one key).

    Items are counted by key first. Keys of up to LONG items are folded whole, many in a
    task; longer ones are cut into runs over many tasks (``chunk_ids``).
    """
    rows = items.select(*keys, order, text, cost)
    long = written(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > LONG).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]), "long")
    if long.isEmpty():
        return _whole_keys(rows, keys, order, text, cost, budget, sep, joiner)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    runs = chunk_ids(rows.join(long, same, "left_semi"), keys, order, cost, budget, sep)
    runs = runs.groupBy(*keys, "chunk_id").agg(ordered_join(order, text, joiner).alias("chunk"), F.count("*").alias("n_items"))
    return _whole_keys(rows.join(long, same, "left_anti"), keys, order, text, cost, budget, sep, joiner).unionByName(runs)


def cut(lines: DataFrame, boundaries: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Segments of ordered lines; each boundary (keys, order) starts one. Empty segments do not arise, boundaries past the end cut nothing."""
    marks = boundaries.where(F.col(order) > 0).select(*keys, order).distinct().withColumn("__b", F.lit(1))
    w = Window.partitionBy(*keys).orderBy(order)
    rows = lines.join(marks, [*keys, order], "left").withColumn("segment", F.sum(F.coalesce("__b", F.lit(0))).over(w))
    return rows.groupBy(*keys, "segment").agg(ordered_join(order, text, "\n").alias("chunk"), F.count("*").alias("n_lines"))


def first_line(chunk: Column) -> Column:
    """The first line that isn't blank, stripped; null without one."""
    return F.element_at(F.filter(F.transform(F.split(chunk, "\n"), strip), lambda x: F.length(x) > 0), 1)
