"""Inner products of many vectors, block against block.

Vectors are dealt to blocks within their key; each pair of blocks is one task, which
multiplies tile by tile. A block is sent to as many tasks as its key has blocks. It
has ``block`` vectors until there are PARTS blocks, then grows with its key up to
SPAN vectors, so what is shuffled is PARTS times the vectors first and n / SPAN times
in the end, while nothing is broadcast and no task holds more than two blocks and the
products of two tiles. What need not leave a task does not: pairs below a threshold,
all but sums, maxima or the k best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

PARTS = 16  # blocks of a key before its blocks grow
SIDES = 4  # the same of queries, whose blocks meet those of all rows
SPAN = 32_768  # vectors of a block at most, unless more are asked for
RUN = 4_000_000  # pairs that a task puts in order at once
TILE = 2048  # vectors of each side that are multiplied at once
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def matrix(batches: list[pa.RecordBatch], column: str) -> np.ndarray:
    """The lists of a column, all of one length, as rows of doubles."""
    n = sum(b.num_rows for b in batches)
    flat = [b.column(column).flatten().to_numpy(zero_copy_only=False) for b in batches]
    return np.concatenate(flat).astype(float).reshape(n, -1)


def dealt(rows: DataFrame, keys: list[str], block: int, by: str = "id", parts: int | None = None) -> DataFrame:
    """rows with b, their block by a hash, and blocks, how many their key has; ``parts``: before they grow (PARTS)."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("__n")) if keys else rows.agg(F.count("*").alias("__n"))
    if keys:  # only keys of more than one block are told apart; a join that deals rows by key would leave all blocks of a key to one task
        rows = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
        sized = rows.join(F.broadcast(n.where(F.col("__n") > block)), keys, "left").fillna(1, ["__n"])
    else:
        sized = rows.join(F.broadcast(n), F.lit(True))
    span = F.greatest(F.lit(block), F.least(F.lit(SPAN), F.ceil(F.col("__n") / (parts or PARTS))))
    sized = sized.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("__n") / span)).cast("int")).drop("__n")
    return sized.withColumn("b", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))


def _shaped(vectors: DataFrame, id_col: str, vec_col: str, keys: list[str]) -> DataFrame:
    floats = vectors.select(vec_col).dtypes[0][1] == "array<float>"  # sent as they are, multiplied as doubles
    v = F.col(vec_col) if floats else F.col(vec_col).cast("array<double>")
    rows = vectors.select(*keys, F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.where("id is not null and v is not null")


def least(over: float, digits: int) -> float:
    """The smallest number that is over ``over`` when it is rounded to ``digits``."""
    if not np.isfinite(over):
        return np.nextafter(over, np.inf)
    span = 10.0**-digits + abs(over) * 1e-9
    low, high = over - span, over + span
    while (mid := (low + high) / 2) not in (low, high):
        low, high = (low, mid) if np.round(mid, digits) > over else (mid, high)
    return high


def by_value(parts: Iterator[tuple]) -> Iterator[tuple]:
    """The rows of column parts in runs of about RUN, each ordered by its last column and cut into parts of 100,000.

    Equal values of a run stand together, so a stored result takes half the space: rounded
    products are too many for a dictionary and take eight bytes each where they are in no order.
    """
    held: list[tuple] = []

    def ordered() -> Iterator[tuple]:
        columns = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        order = np.argsort(columns[-1])
        for z in range(0, len(order), 100_000):
            yield tuple(c[order[z : z + 100_000]] for c in columns)

    for part in parts:
        held.append(part)
        if sum(len(p[0]) for p in held) >= RUN:
            yield from ordered()
    if held:
        yield from ordered()


def tiles(groups: np.ndarray | None, n: int, tile: int) -> list[tuple[int, int]]:
    """Ranges of about ``tile`` of n rows; a run of equal ``groups`` is not cut."""
    starts = np.arange(0, n, tile)
    if groups is not None:
        first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        starts = np.unique(first[np.searchsorted(first, starts, "right") - 1])
    return list(zip(starts, np.r_[starts[1:], n]))


def _products(sent: DataFrame, keys: list[str], normalize: bool, emit: Callable, columns: str, group: Callable | None = None, value: bool = False) -> DataFrame:
    """``emit(ids, other ids, products, same tile)`` for the tiles of the two sides (0 and 1, or -1 for both) of every (keys, p, q).

    Ids of a tile ascend; with ``group`` (ids to groups) they go by group, and a group that a block holds is in one tile.
    ``value``: the last column is a value by which rows are put in order (``by_value``).
    """
    kinds, tile = dict(sent.dtypes), TILE
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), columns])
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        ids, side = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in ("id", "side"))
        m = matrix(held, "v")
        del held
        if normalize:
            size = np.sqrt((m**2).sum(1, keepdims=True))
            m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
        order = np.lexsort((ids, group(ids))) if group else np.argsort(ids, kind="stable")
        ids, side, m = ids[order], side[order], m[order]
        both = bool((side < 0).any())
        left = np.flatnonzero(side != 1)
        right = left if both else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return
        a, b, x, y = ids[left], ids[right], m[left], m[right].T
        ends = [tiles(group(i) if group else None, len(i), tile) for i in (a, b)]
        met = ((t, r, u, c) for t, r in enumerate(ends[0]) for u, c in enumerate(ends[1]) if not both or u >= t)
        found = (part for t, (r, s), u, (c, d) in met for part in emit(a[r:s], b[c:d], x[r:s] @ y[:, c:d], both and u == t))
        for part in by_value(found) if value else found:
            n = len(part[0])
            yield pa.RecordBatch.from_arrays([*(pa.repeat(pa.scalar(key[i].as_py(), _ARROW[kinds[k]]), n) for i, k in enumerate(keys)), *map(pa.array, part)], names)

    return sent.groupBy(*keys, "p", "q").applyInArrow(run, schema)


def _self(vectors: DataFrame, id_col: str, vec_col: str, keys: list[str], block: int, owner: Callable | None = None) -> DataFrame:
    v = _shaped(vectors, id_col, vec_col, keys)
    v = dealt(v if owner is None else v.withColumn("__o", owner("id")), keys, block, "id" if owner is None else "__o")
    return paired(v, *keys, "id", "v")


def paired(rows: DataFrame, *cols: str) -> DataFrame:
    """cols with p, q, side: every row of ``dealt`` once for each pair of blocks that its own is part of."""
    v = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return v.select(*cols, F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), F.when(F.col("b") == F.col("o"), -1).when(F.col("b") < F.col("o"), 0).otherwise(1).alias("side"))


def all_pairs(vectors: DataFrame, id_col: str, vec_col: str, over: float | None = None, normalize: bool = False, block: int = 2048, digits: int = 6, keys: list[str] | None = None) -> DataFrame:
    """keys, i, j, sim for i < j of one key, rounded to ``digits``; sim > over if given. ``normalize`` gives cosines (0 for zero vectors)."""

    from_ = None if over is None else least(over, digits)

    def emit(a: np.ndarray, b: np.ndarray, sim: np.ndarray, same: bool) -> Iterator[tuple]:
        ok = np.ones(sim.shape, bool) if over is None else sim >= from_
        if same:
            ok &= a[:, None] < b
        elif np.isin(a, b).any():
            ok &= a[:, None] != b
        at = np.flatnonzero(ok)
        x, y = np.divmod(at, len(b))
        yield np.minimum(a[x], b[y]), np.maximum(a[x], b[y]), np.round(sim.ravel()[at], digits)

    return _products(_self(vectors, id_col, vec_col, keys or [], block), keys or [], normalize, emit, "i bigint, j bigint, sim double", value=True)


def row_sums(vectors: DataFrame, id_col: str, vec_col: str, block: int = 2048, digits: int = 6, keys: list[str] | None = None) -> DataFrame:
    """keys, i, n, total: how many other vectors of its key there are and the sum of the products with them."""

    def emit(a: np.ndarray, b: np.ndarray, sim: np.ndarray, same: bool) -> Iterator[tuple]:
        sim = np.round(sim, digits)
        other = a[:, None] != b
        sim[~other] = 0
        yield a, other.sum(1), sim.sum(1)
        if not same:
            yield b, other.sum(0), sim.sum(0)

    parts = _products(_self(vectors, id_col, vec_col, keys or [], block), keys or [], False, emit, "i bigint, n bigint, total double")
    return parts.groupBy(*(keys or []), "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def owner_maxima(vectors: DataFrame, id_col: str, vec_col: str, owner: Callable, block: int = 2048, digits: int = 6, keys: list[str] | None = None) -> DataFrame:
    """keys, src, dst, sim: the largest product between members of two owners src < dst; ``owner`` maps an array of ids to owners.

    Vectors are dealt by owner, so a task has all members of the two and its maxima are
    the result. Only if an owner has more than TILE members are they dealt by id, and
    the maxima of the tasks go through one more aggregation.
    """
    keys = keys or []

    @pandas_udf("long")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series(owner(ids.to_numpy()))

    def emit(a: np.ndarray, b: np.ndarray, sim: np.ndarray, same: bool) -> Iterator[tuple]:
        x, ax = np.unique(owner(a), return_index=True)
        y, by = np.unique(owner(b), return_index=True)
        best = np.round(np.maximum.reduceat(np.maximum.reduceat(sim, ax, axis=0), by, axis=1), digits)
        i, j = np.nonzero(x[:, None] < y if same else x[:, None] != y)
        for z in range(0, len(i), 100_000):
            s, t = x[i[z : z + 100_000]], y[j[z : z + 100_000]]
            yield np.minimum(s, t), np.maximum(s, t), best[i[z : z + 100_000], j[z : z + 100_000]]

    members = _shaped(vectors, id_col, vec_col, keys).groupBy(*keys, of("id").alias("o")).agg(F.count("*").alias("n"))
    whole = members.where(F.col("n") > TILE).isEmpty()
    sent = _self(vectors, id_col, vec_col, keys, block, of if whole else None)
    parts = _products(sent, keys, False, emit, "src bigint, dst bigint, sim double", owner)
    return parts if whole else parts.groupBy(*keys, "src", "dst").agg(F.max("sim").alias("sim"))


def _met(left: DataFrame, right: DataFrame, *cols: str) -> DataFrame:
    """cols with p, q, side: every row of two ``dealt`` sides once for each block of the other."""
    many = lambda t: F.broadcast(t.agg(F.max("blocks").alias("__o")))  # noqa: E731  one number
    each = F.explode(F.sequence(F.lit(0), F.col("__o") - 1))
    a = left.join(many(right), F.lit(True)).select(*cols, F.col("b").alias("p"), each.alias("q"), F.lit(0).alias("side"))
    return a.unionByName(right.join(many(left), F.lit(True)).select(*cols, each.alias("p"), F.col("b").alias("q"), F.lit(1).alias("side")))


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vec_col: str, k: int, block: int = 2048, digits: int = 6) -> DataFrame:
    """q_id, item, score, rk: the k rows of the largest products with each query, but for the row of its own id; ties to the smaller id.

    Every query meets every row, block against block; a task passes on the k best of
    each of its queries and tiles.
    """
    sent = _met(dealt(_shaped(queries, id_col, vec_col, []), [], block, parts=SIDES), dealt(_shaped(rows, id_col, vec_col, []), [], block), "id", "v")

    def emit(a: np.ndarray, b: np.ndarray, sim: np.ndarray, _: bool) -> Iterator[tuple]:
        sim = np.round(sim, digits)
        sim[(a[:, None] == b) | ~np.isfinite(sim)] = -np.inf
        least = np.partition(sim, -k, axis=1)[:, -k, None] if k < sim.shape[1] else -np.inf
        x, y = np.nonzero((sim >= least) & (sim > -np.inf))
        order = np.lexsort((b[y], -sim[x, y], x))
        x, y = x[order], y[order]
        first = np.searchsorted(x, x)  # where a query's rows begin
        ok = np.arange(len(x)) - first < k
        yield a[x[ok]], b[y[ok]], sim[x[ok], y[ok]]

    got = _products(sent, [], False, emit, "q_id bigint, item bigint, score double")
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "item")
    return got.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


START, SEEN, QUESTION = 0, 1, 2


def neighbors(starts: DataFrame, rows: DataFrame, id_col: str, vec_col: str, over: float, seen: DataFrame | None = None, questions: DataFrame | None = None, passes: Callable | None = None, block: int = 2048, digits: int = 6) -> DataFrame:
    """q_id, node: the rows that have a product over the threshold with another row that is a start of the query, but for its starts and what it has ``seen``.

    starts, seen: q_id, node (ids of rows). questions: q_id, vec_col; with them a
    row is only found if ``passes`` (arrays of rounded products to booleans) says so of its
    product with the query's own vector.

    As ``graph.unvisited_neighbors`` on the graph of all products over the threshold,
    which is never made: starts meet rows, block against block, and a query is dealt
    whole, so what a task finds is final and nothing it found is shuffled. A task holds
    all starts and seen rows of a query.
    """
    c = _shaped(rows, id_col, vec_col, [])
    known = starts.select("q_id", "node", F.lit(START).alias("kind"))
    if seen is not None:
        known = known.unionByName(seen.select("q_id", "node", F.lit(SEEN).alias("kind")))
    left = known.join(c.withColumnRenamed("id", "node"), "node").select(F.col("q_id").cast("long").alias("q_id"), F.col("node").cast("long").alias("id"), "v", "kind")
    if questions is not None:
        own = _shaped(questions, "q_id", vec_col, []).join(starts.select("q_id").distinct().withColumnRenamed("q_id", "id"), "id", "left_semi")
        left = left.unionByName(own.select(F.col("id").alias("q_id"), "id", "v", F.lit(QUESTION).alias("kind")))
    right = dealt(c, [], block).select("*", F.lit(0).cast("long").alias("q_id"), F.lit(SEEN).alias("kind"))
    sent = _met(dealt(left, [], block, "q_id", SIDES), right, "q_id", "id", "v", "kind")
    tile = TILE

    def run(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        q, ids, kind, side = (np.concatenate([x.column(n).to_numpy(zero_copy_only=False) for x in held]) for n in ("q_id", "id", "kind", "side"))
        m = matrix(held, "v")
        del held
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left, right = left[np.argsort(q[left], kind="stable")], right[np.argsort(ids[right], kind="stable")]
        if not len(left) or not len(right):
            return
        for r, s in tiles(q[left], len(left), tile):
            a = left[r:s]
            names, first, of = np.unique(q[a], return_index=True, return_inverse=True)
            for c, d in tiles(ids[right], len(right), tile):
                b = right[c:d]
                sim = np.round(m[a] @ m[b].T, digits)
                found = np.logical_or.reduceat((sim > over) & (kind[a] == START)[:, None] & (ids[a][:, None] != ids[b]), first, axis=0)
                if passes is not None:
                    good, asks = np.zeros(found.shape, bool), np.flatnonzero(kind[a] == QUESTION)
                    good[of[asks]] = passes(sim[asks])
                    found &= good
                nodes, at = np.unique(ids[b], return_index=True)
                found = np.logical_or.reduceat(found, at, axis=1)
                place = np.minimum(np.searchsorted(nodes, ids[a]), len(nodes) - 1)
                old = (kind[a] != QUESTION) & (nodes[place] == ids[a])
                found[of[old], place[old]] = False
                i, j = np.nonzero(found)
                for z in range(0, len(i), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(names[i[z : z + 100_000]]), pa.array(nodes[j[z : z + 100_000]])], ["q_id", "node"])

    return sent.groupBy("p", "q").applyInArrow(run, "q_id bigint, node bigint")
