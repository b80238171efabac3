"""The hash-prefix forest against brute force."""

from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import ann_forest

SCHEMA = "vec_id long, embedding array<float>"


def brute(v, ids, q, k=5):
    """The k nearest by double precision cosine, ties to the smaller id."""
    d = v.astype(float)
    s = d @ d[q] / (np.sqrt((d**2).sum(1)) * np.sqrt((d[q] ** 2).sum()))
    s[q] = -9
    return [int(ids[i]) for i in np.lexsort((ids, -np.round(s, 12)))[:k]]


def search(spark, v, **parameters):
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA)
    s = ann_forest.Search(table, 50, 5, parameters.pop("trees", 64), parameters.pop("target", 0.95), 11)
    got = defaultdict(list)
    for r in s.nearest.orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    scored = defaultdict(set)
    for r in s.found.select("q", "cids").collect():
        scored[r.q] |= set(np.frombuffer(bytes(r.cids), np.int64).tolist())
    share = sum(map(len, scored.values())) / len(scored) / s.n
    ids = np.arange(len(v))
    hit = sum(len(set(brute(v, ids, q)) & set(got[q])) for q in range(0, len(v), 50))
    assert set(got) == set(range(0, len(v), 50)) and all(len(x) == 5 for x in got.values())
    return hit / 5 / len(got), share


def test_clustered_vectors_need_few_candidates(spark):
    r = np.random.default_rng(5)
    v = (r.standard_normal((150, 48))[r.integers(0, 150, 6000)] + 0.25 * r.standard_normal((6000, 48))).astype(np.float32)
    recall, share = search(spark, v)
    assert recall >= 0.9 and share < 0.2, (recall, share)


@pytest.mark.parametrize("cell", [64, 16_384])
def test_random_directions(spark, monkeypatch, cell):
    """The hardest case: most rows are left out all the same, whatever the size of the cells."""
    monkeypatch.setattr(ann_forest, "CELL", cell)
    v = np.random.default_rng(6).standard_normal((4000, 32)).astype(np.float32)
    recall, share = search(spark, v)
    assert recall >= 0.9 and share < 0.5, (recall, share)


def test_crowded_cells(spark, monkeypatch):
    """A third of all rows in one tight group: its cells are cut deeper, equal strings by a salt, and slices share a shard."""
    monkeypatch.setattr(ann_forest, "CELL", 32)
    monkeypatch.setattr(ann_forest, "ASKED", 2_000)
    monkeypatch.setattr(ann_forest, "SHARD", 500)
    r = np.random.default_rng(7)
    v = r.standard_normal((1500, 16)).astype(np.float32)
    v[500:1000] = v[3] + 1e-3 * r.standard_normal((500, 16)).astype(np.float32)
    recall, _ = search(spark, v)
    assert recall >= 0.9, recall


def test_nearest(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((400, 16)).astype(np.float32)
    v[300:] = v[7]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(1000, None, 0), (1050, [0.0] * 16, 0), (1100, [float("nan")] + [1.0] * 15, 0), (1150, [None] + [1.0] * 15, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for x in ann_forest.nearest(table).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    d = v.astype(float)
    n = np.sqrt((d**2).sum(1))
    hit = 0
    for q in range(0, 400, 50):
        s = d @ d[q] / (n * n[q])
        s[q] = -9
        best = np.lexsort((np.arange(400), -np.round(s, 12)))[:5]
        hit += len({int(b) for b in best} & {x[0] for x in got[q]})
    assert set(got) == set(range(0, 400, 50)) and hit >= 0.9 * 40
    assert [x[0] for x in got[300]] == [7, 301, 302, 303, 304]


def test_nearest_ties_of_scaled_copies(spark):
    """More distinct vectors of one direction than any short list holds: the smallest ids are the nearest."""
    v = np.random.default_rng(3).standard_normal(16).astype(np.float32)
    scale = [2.0 ** ((37 * i) % 61 - 30) for i in range(61)]
    table = spark.createDataFrame([(i, (v * np.float32(s)).tolist()) for i, s in enumerate(scale)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for x in ann_forest.nearest(table).orderBy("query_id", "rank").collect():
        got[x.query_id].append(x.vec_id)
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4]}


def test_few_rows_and_long_vectors(spark):
    assert ann_forest.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann_forest.nearest(spark.createDataFrame([(0, [1.0, 2.0])], SCHEMA)).count() == 0
    assert ann_forest.nearest(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], SCHEMA)).count() == 0
    v = np.random.default_rng(8).standard_normal((3, 4096)).astype(np.float32)
    table = spark.createDataFrame([(100 * i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (7, [1.0])], SCHEMA)
    got = {(r.query_id, r.rank): r.vec_id for r in ann_forest.nearest(table).collect()}
    assert {q for q, _ in got} == {0, 100, 200} and len(got) == 6
