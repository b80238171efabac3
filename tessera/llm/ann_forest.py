"""Approximate nearest neighbours by a hash-prefix forest.

Rows with equal vectors form one class, so a vector shared by many rows is one
entry (with its k + 1 smallest ids, more cannot be among the nearest).

1. *Forest*, written once. Each of ``trees`` trees gives a class a hash string of
   ``BITS`` signs of random projections. A tree's sorted array of strings is kept in
   cells by string prefix, of ``CELL`` entries on average; a cell of more is dealt to
   several salted ones.
2. *Descent*. A query goes only to the cells of its own prefixes, one a tree, which
   tell for every length how many entries share that much of its string. Summed
   over the trees this says how far all trees must ascend together, from the
   longest match up bit by bit, until ``enough`` entries lie below them. Should a
   cell's prefix be too long for that, all cells below a shorter one are asked.
3. *Candidates* are the entries below those prefixes. They are scored exactly, in
   shards of the classes; a shard that much is asked of is asked in slices.

``enough`` is measured, not given: for a bounded sample of the queries (``SAMPLE``,
smallest hashes first) the true nearest are found by brute force, and ``enough`` is
the least that finds the share ``target`` of them. Clustered vectors need few
candidates, random directions a third of all rows; the same rule serves both.

Defined results: null, zero, non-finite vectors and vectors holding nulls take
no part; nor do those of another length than most (the smaller on ties); null
ids neither; rows that share id and vector count once; ties go to the smaller
id, over all candidates; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Workspace

BITS = 32
CELL = 16_384  # entries of a tree that share a cell, on average
SHARD = 16_384  # classes that are scored together
DEAL = 20_000  # classes that a task hashes at once
ASKED = 4_000_000  # candidates that a shard scores in one slice
SAMPLE = 256
CELL_KEY = ["tree", "depth", "cell"]
DEALT = "tree int, depth int, cell long, n long, blob binary"
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<float>) of the rows that take part."""
    out = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("v"))
    return out.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad_of("v") & F.exists("v", lambda x: x != 0))


def bad_of(c: str):
    return F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """v, ids: each distinct vector with its k + 1 smallest ids (ranked per task first, then per vector)."""
    w = Window.partitionBy("v").orderBy("vec_id")
    first = rows.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    return first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


class Hasher:
    """The hash strings of all trees, drawn anew from the seed wherever they are needed."""

    def __init__(self, dim: int, trees: int, seed: int) -> None:
        self.planes = np.random.default_rng(seed).standard_normal((dim, trees * BITS))
        self.trees = trees

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """n x trees strings, the first projection as the highest bit."""
        unit = vectors.astype(np.float64)
        unit /= np.sqrt((unit**2).sum(1, keepdims=True))
        out = np.empty((len(unit), self.trees), np.int64)
        weight = 1 << np.arange(BITS - 1, -1, -1)
        for t in range(self.trees):
            out[:, t] = ((unit @ self.planes[:, t * BITS : (t + 1) * BITS]) >= 0) @ weight
        return out


def _vectors(b: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return np.asarray(b.column(b.schema.get_field_index(name)).flatten(), np.float32).reshape(-1, dim)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names)


def _column(b: pa.RecordBatch, name: str) -> list:
    return b.column(b.schema.get_field_index(name)).to_pylist()


def _cut(t: int, code: np.ndarray, key: np.ndarray, depth: int) -> list[tuple]:
    """(tree, depth, cell, n, blob) of sorted strings, by their first ``depth`` bits."""
    cell = code >> (BITS - depth)
    at = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(code)]
    return [(t, depth, int(cell[a]), int(z - a), np.stack([code[a:z], key[a:z]]).tobytes()) for a, z in zip(at, at[1:])]


def deal(rows: DataFrame, dim: int, trees: int, depth: int, seed: int) -> DataFrame:
    """tree, depth, cell, n, blob: the strings and classes of a block of rows that fall into a cell, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ids, vecs = Hasher(dim, trees, seed), [], []

        def flush() -> pa.RecordBatch:
            code, own, out = hasher.codes(np.concatenate(vecs)), np.array(ids, np.int64), []
            for t in range(trees):
                order = np.argsort(code[:, t], kind="stable")
                out += _cut(t, code[order, t], own[order], depth)
            return _batch(out, DEALT)

        for b in batches:
            ids += _column(b, "cid")
            vecs.append(_vectors(b, "v", dim))
            if len(ids) >= DEAL:
                yield flush()
                ids, vecs = [], []
        if ids:
            yield flush()

    return rows.select("cid", "v").mapInArrow(run, DEALT)


def _deeper(dealt: DataFrame, depth: int) -> DataFrame:
    """Packed blocks cut by longer prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, blob in zip(_column(b, "tree"), _column(b, "blob")):
                out += _cut(t, *np.frombuffer(blob, np.int64).reshape(2, -1), depth)
            if out:
                yield _batch(out, DEALT)

    return dealt.select("tree", "blob").mapInArrow(run, DEALT)


def _pairs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings and keys of packed blobs, sorted by string."""
    both = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in blobs], axis=1)
    order = np.argsort(both[0], kind="stable")
    return both[0][order], both[1][order]


class Forest:
    """The written forest of a table of classes, and the steps of a search in it."""

    def __init__(self, ws: Workspace, index: DataFrame, n: int, dim: int, trees: int, seed: int) -> None:
        self.ws, self.dim, self.trees, self.seed = ws, dim, trees, seed
        depth = max(0, (-(-n // CELL) - 1).bit_length())
        dealt = ws.write(deal(index, dim, trees, depth, seed), "dealt", clean=True)
        blocks, cells, self.depths = None, None, []
        while True:  # one round, and one more for what is crowded
            self.depths.append(depth)
            sizes = ws.write(dealt.groupBy("tree", "depth", "cell").agg(F.sum("n").alias("n")), "sizes")
            crowded = sizes.where(F.col("n") > (2 * CELL if depth < BITS else 1 << 60)).select("tree", "cell")
            own = sizes.join(crowded, ["tree", "cell"], "left_anti").select("tree", "depth", "cell", "n")
            done = dealt.join(crowded, ["tree", "cell"], "left_anti").select("tree", "depth", "cell", "blob")
            cells = own if cells is None else cells.unionByName(own)
            blocks = done if blocks is None else blocks.unionByName(done)
            if crowded.isEmpty():
                break
            depth = min(BITS, depth + 4)
            dealt = ws.write(_deeper(dealt.join(crowded, ["tree", "cell"], "left_semi"), depth), "dealt", clean=True)
        self.cells = ws.write(cells.withColumn("salts", F.ceil(F.col("n") / (2 * CELL)).cast("int")), "cells")

        def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code, cid = _pairs([x for b in batches for x in _column(b, "blob")])
            yield _batch([(*(k.as_py() for k in key), np.stack([code, cid]).tobytes())], "tree int, depth int, cell long, salt int, blob binary")

        salted = blocks.join(self.cells.drop("n"), CELL_KEY).withColumn("salt", F.pmod(F.xxhash64("blob"), F.col("salts")).cast("int"))
        built = salted.select(*CELL_KEY, "salt", "blob").groupBy(*CELL_KEY, "salt").applyInArrow(build, "tree int, depth int, cell long, salt int, blob binary")
        self.arrays = ws.write(built, "forest", clean=True)

    def asks(self, queries: DataFrame) -> DataFrame:
        """tree, depth, cell, q, code: the string of every query in every tree, and the cell that holds it (which has the query's own class)."""
        dim, trees, seed = self.dim, self.trees, self.seed
        schema = "tree int, q long, code long"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher(dim, trees, seed)
            for b in batches:
                q, code = _column(b, "q"), hasher.codes(_vectors(b, "v", dim))
                if q:
                    yield _batch([(t, x, int(code[i, t])) for i, x in enumerate(q) for t in range(trees)], schema)

        rows = queries.select("q", "v").mapInArrow(run, schema).withColumn("depth", F.explode(F.array(*map(F.lit, self.depths))))
        return rows.withColumn("cell", _prefix("depth")).join(self.cells.select(*CELL_KEY), CELL_KEY).select(*CELL_KEY, "q", "code")

    def _visit(self, asks: DataFrame, answer, schema: str) -> DataFrame:
        """``answer(cell's strings, classes, depth, asked strings, queries, levels)`` in every (salt of a) cell that is asked."""
        asks = asks.join(self.cells.drop("n"), CELL_KEY).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        rows = asks.select(*CELL_KEY, "salt", "q", "code", "level", F.lit(None).cast("binary").alias("blob"))
        rows = rows.unionByName(self.arrays.select(*CELL_KEY, "salt", *[F.lit(None).cast(t).alias(c) for c, t in (("q", "long"), ("code", "long"), ("level", "int"))], "blob"))

        def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code, cid, asked = np.empty(0, np.int64), np.empty(0, np.int64), []
            for b in batches:
                blobs = b.column(b.schema.get_field_index("blob"))
                for x in blobs.drop_null().to_pylist():
                    code, cid = np.frombuffer(x, np.int64).reshape(2, -1)
                part = b.filter(blobs.is_null())
                if len(part):
                    asked.append(np.stack([np.array(_column(part, c), np.int64) for c in ("code", "q", "level")]))
            if asked:
                yield from answer(code, cid, key[1].as_py(), *np.concatenate(asked, 1))

        return rows.groupBy(*CELL_KEY, "salt").applyInArrow(run, schema)

    def descend(self, asks: DataFrame) -> DataFrame:
        """q, c0 ... c32: how many entries share at least so many bits with the query, over the trees whose cell has no longer prefix."""
        schema = "q long, c array<long>"

        def answer(code: np.ndarray, _: np.ndarray, depth: int, own: np.ndarray, q: np.ndarray, __: np.ndarray) -> Iterator[pa.RecordBatch]:
            many = np.zeros((len(q), BITS + 1), np.int64)
            for x in range(depth, BITS + 1):
                low = (own >> (BITS - x)) << (BITS - x)
                many[:, x] = np.searchsorted(code, low + (1 << (BITS - x))) - np.searchsorted(code, low)
            for z in range(0, len(q), 20_000):
                yield _batch(list(zip(q[z : z + 20_000].tolist(), many[z : z + 20_000].tolist())), schema)

        got = self._visit(asks.withColumn("level", F.lit(0)), answer, schema)
        return got.groupBy("q").agg(*[F.sum(F.col("c")[x]).alias(f"c{x}") for x in range(BITS + 1)])

    def whole(self, counts: DataFrame, asks: DataFrame) -> DataFrame:
        """q, x, n: the entries that share at least x bits with the query, over all trees; asks are of the queries in counts."""
        above = F.explode(F.sequence(F.lit(0), F.col("depth") - 1))
        up = self.cells.where("depth > 0").select("tree", "n", "depth", "cell", above.alias("x"))
        up = up.select("tree", "x", F.expr("shiftright(cell, depth - x)").alias("cell"), "n").groupBy("tree", "x", "cell").agg(F.sum("n").alias("n"))
        own = asks.where("depth > 0").select("q", "tree", "code", above.alias("x")).withColumn("cell", _prefix("x"))
        longer = own.join(up, ["tree", "x", "cell"]).select("q", "x", "n")
        each = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.col(f"c{x}").alias("n")) for x in range(BITS + 1)])).alias("e")
        return counts.select("q", each).select("q", "e.x", "e.n").unionByName(longer).groupBy("q", "x").agg(F.sum("n").alias("n"))

    def levels(self, counts: DataFrame, asks: DataFrame, enough: int) -> DataFrame:
        """q, level: the longest common length at which at least ``enough`` entries lie below the prefixes (0 if all are too few)."""
        level = F.lit(-1)
        for x in range(self.depths[0], BITS + 1):
            level = F.when(F.col(f"c{x}") >= enough, x).otherwise(level)
        known = counts.select("q", level.alias("level"))
        short = counts.join(known.where("level < 0").select("q"), "q", "left_semi")
        rest = self.whole(short, asks.join(short.select("q"), "q", "left_semi"))
        rest = rest.groupBy("q").agg(F.coalesce(F.max(F.when(F.col("n") >= enough, F.col("x"))), F.lit(0)).alias("level"))
        return known.where("level >= 0").unionByName(rest)

    def ascend(self, asks: DataFrame, levels: DataFrame, shards: int) -> DataFrame:
        """shard, q, n, cids: the candidates, by the shard of their class."""
        schema = "shard int, q long, n int, cids binary"
        at = asks.join(levels, "q")
        inside = at.where("level >= depth")
        under = self.cells.where("depth > 0").select("tree", "depth", "cell", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("level")).withColumn("above", F.expr("shiftright(cell, depth - level)"))
        wide = at.where("level < depth").select("tree", "q", "code", "level", _prefix("level").alias("above")).join(under, ["tree", "level", "above"])
        every = inside.select(*CELL_KEY, "q", "code", "level").unionByName(wide.select(*CELL_KEY, "q", "code", "level"))

        def answer(code: np.ndarray, cid: np.ndarray, _: int, own: np.ndarray, q: np.ndarray, level: np.ndarray) -> Iterator[pa.RecordBatch]:
            rows, held = [], 0
            home = _shard(cid, shards)
            low = (own >> (BITS - level)) << (BITS - level)
            first, last = np.searchsorted(code, low), np.searchsorted(code, low + (1 << (BITS - level)))
            for i in np.flatnonzero(first < last):
                h, c = home[first[i] : last[i]], cid[first[i] : last[i]]
                order = np.lexsort((c, h))
                h, c = h[order], c[order]
                cut = [0, *(np.flatnonzero(np.diff(h)) + 1), len(h)]
                rows += [(int(h[a]), int(q[i]), int(z - a), c[a:z].tobytes()) for a, z in zip(cut, cut[1:])]
                held += len(c)
                if held > 500_000 or len(rows) > 50_000:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, schema)

        return self._visit(every, answer, schema)


def _prefix(length: str):
    return F.expr(f"shiftright(code, {BITS} - {length})")


def _shard(cid: np.ndarray, shards: int) -> np.ndarray:
    return (((cid & 0x1FFFFFFFF) + (cid >> 33) * 7919) % shards).astype(np.int32)


def _best(unit: np.ndarray, norm: np.ndarray, ids: list, q: np.ndarray, k: int) -> list[tuple[float, int]]:
    """(-score, vec_id) of the k + 1 nearest rows among classes (vectors, norms, ids), ties to the smaller id."""
    score = (unit * q).sum(1) / (norm * np.sqrt((q * q).sum()))
    if len(score) > k + 1:
        near = np.flatnonzero(score >= -np.partition(-score, k)[k])  # all that tie with the last one stay
    else:
        near = np.arange(len(score))
    return sorted((-float(score[i]), v) for i in near for v in ids[i])[: k + 1]


def score(ws: Workspace, index: DataFrame, queries: DataFrame, found: DataFrame, shards: int, dim: int, k: int) -> DataFrame:
    """q, vec_id, score: the k + 1 nearest of every query among its candidates in a shard. found is a written table."""
    load = found.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.ceil(F.col("n") / ASKED).cast("int").alias("slices"))
    load = ws.write(load, "load")
    own = F.pmod(F.xxhash64("q"), F.col("slices")).cast("int").alias("slice")
    none = {"q": "long", "cids": "binary", "cid": "long", "v": "array<float>", "ids": "array<long>"}

    def shaped(rows: DataFrame, kind: int) -> DataFrame:
        return rows.select("shard", "slice", F.lit(kind).alias("kind"), *[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()])

    asked = shaped(found.join(load, "shard").select("shard", own, "q", "cids"), 2)
    touched = shaped(found.select("shard", "q").distinct().join(load, "shard").join(queries.select("q", "v"), "q").select("shard", own, "q", "v"), 1)
    home = F.expr(f"cast(((cid & {0x1FFFFFFFF}) + shiftright(cid, 33) * 7919) % {shards} AS int)")  # as _shard
    held = index.withColumn("shard", home).join(load, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = asked.unionByName(touched).unionByName(shaped(held, 0))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, ids, vecs, vector, cand = [], [], [], {}, {}
        for b in batches:
            kind = np.array(_column(b, "kind"))
            if (kind == 0).any():
                part = b.filter(pa.array(kind == 0))
                cid += _column(part, "cid")
                ids += _column(part, "ids")
                vecs.append(_vectors(part, "v", dim))
            if (kind == 1).any():
                part = b.filter(pa.array(kind == 1))
                vector |= dict(zip(_column(part, "q"), _vectors(part, "v", dim).astype(np.float64)))
            if (kind == 2).any():
                part = b.filter(pa.array(kind == 2))
                for q, x in zip(_column(part, "q"), _column(part, "cids")):
                    cand.setdefault(q, []).append(x)
        if not cand:
            return
        order = np.argsort(np.array(cid, np.int64))
        cid, ids = np.array(cid, np.int64)[order], [ids[i] for i in order]
        vecs = np.concatenate(vecs)[order].astype(np.float64)
        norm = np.sqrt((vecs**2).sum(1))
        out = []
        for q, parts in cand.items():
            hit = np.zeros(len(cid), bool)
            for x in parts:
                hit[np.searchsorted(cid, np.frombuffer(x, np.int64))] = True
            at = np.flatnonzero(hit)
            out += [(q, v, -s) for s, v in _best(vecs[at], norm[at], [ids[i] for i in at], vector[q], k)]
            if len(out) > 20_000:
                yield _batch(out, "q long, vec_id long, score double")
                out = []
        if out:
            yield _batch(out, "q long, vec_id long, score double")

    return rows.groupBy("shard", "slice").applyInArrow(run, "q long, vec_id long, score double")


def brute(index: DataFrame, keys: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """q, cid, score: the k + 1 nearest classes of a bounded block of queries, in every task."""
    dim = q.shape[1]
    shared = index.sparkSession.sparkContext.broadcast((keys, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q = shared.value
        q = q / np.sqrt((q**2).sum(1, keepdims=True))
        top, who = np.full((len(q), k + 1), -9.0), np.full((len(q), k + 1), -1, np.int64)
        for b in batches:
            v = _vectors(b, "v", dim).astype(np.float64)
            s = np.concatenate([top, (q @ v.T) / np.sqrt((v**2).sum(1))], 1)
            c = np.concatenate([who, np.broadcast_to(np.array(_column(b, "cid"), np.int64), (len(q), len(v)))], 1)
            at = np.argpartition(-s, k, axis=1)[:, : k + 1]
            top, who = np.take_along_axis(s, at, 1), np.take_along_axis(c, at, 1)
        rows = [(int(keys[i]), int(c), float(s)) for i in range(len(q)) for s, c in zip(top[i], who[i]) if c >= 0]
        if rows:
            yield _batch(rows, "q long, cid long, score double")

    found = index.select("cid", "v").mapInArrow(run, "q long, cid long, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")


def measure(index: DataFrame, queries: DataFrame, asks: DataFrame, counts: DataFrame, forest: Forest, k: int, target: float) -> int:
    """The least number of entries that finds the share ``target`` of the true nearest classes of a sample of the queries."""
    some = queries.orderBy(F.xxhash64("q", F.lit(17)), "q").limit(SAMPLE).select("q", "v")
    sample = some.collect()
    keys, q = np.array([r.q for r in sample], np.int64), np.array([r.v for r in sample], np.float64)
    true = brute(index, keys, q, k).where("q <> cid").join(index.select("cid", F.col("v").alias("w")), "cid").select("q", "w").collect()  # SAMPLE * (k + 1) rows
    if not true:
        return 1
    of = F.broadcast(some.select("q"))
    below = {(r.q, r.x): r.n for r in forest.whole(counts.join(of, "q", "left_semi"), asks.join(of, "q", "left_semi")).collect()}
    hasher = Hasher(forest.dim, forest.trees, forest.seed)
    own = dict(zip(keys.tolist(), hasher.codes(q)))
    need = []
    for code, r in zip(hasher.codes(np.array([r.w for r in true], np.float64)), true):
        shared = BITS - int((own[r.q] ^ code).min()).bit_length()
        need.append(1 if shared == BITS else int(below[r.q, shared + 1]) + 1)
    need.sort()
    return need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)]


class Search:
    """One search: ``found`` has the candidates (written), ``nearest`` the result."""

    def __init__(self, rows: DataFrame, every: int, k: int, trees: int, target: float, seed: int) -> None:
        spark = rows.sparkSession
        ws = self.ws = Workspace(spark, "ann-forest")
        ok = usable(rows)
        lengths = ok.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        self.nearest = spark.createDataFrame([], RESULT)
        self.n = self.scored = 0
        if not lengths:
            return
        dim = lengths[0]["n"]
        ok = ok.where(F.size("v") == dim)
        index = ws.write(classes(ok, k).withColumn("cid", F.monotonically_increasing_id()), "classes")  # written once, so the numbers stay
        self.n = index.count()
        ask = ws.write(ok.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct(), "queries")
        # A query is known by the class of its vector, which is in the index.
        queries = ws.write(index.join(ask.select("v").distinct(), "v", "left_semi").select(F.col("cid").alias("q"), "v"), "distinct")
        if queries.isEmpty():
            return
        forest = Forest(ws, index, self.n, dim, trees, seed)
        asks = ws.write(forest.asks(queries), "asks")
        counts = ws.write(forest.descend(asks), "counts")
        self.enough = measure(index, queries, asks, counts, forest, k, target)
        shards = -(-self.n // SHARD)
        levels = ws.write(forest.levels(counts, asks, self.enough), "levels")
        self.found = ws.write(forest.ascend(asks, levels, shards), "found", clean=True)
        w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        best = score(ws, index, queries, self.found, shards, dim, k)
        top = ws.write(best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r"), "top", clean=True)
        own = ask.join(queries, "v").select(F.col("vec_id").alias("query_id"), "q").join(top, "q").where("query_id <> vec_id")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        out = own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        self.nearest = ws.write(out, "nearest")


def nearest(rows: DataFrame, every: int = 50, k: int = 5, trees: int = 64, target: float = 0.95, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose id is divisible by ``every``."""
    search = Search(rows, every, k, trees, target, seed)
    if search.n and hasattr(search, "found"):
        search.ws.drop_but(search.nearest)
    return search.nearest
