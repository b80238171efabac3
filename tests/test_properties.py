"""Invariants of packing, segmentation, edges and peaks."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import chunking, series
from tessera.operators.blocked import all_pairs, nearest, owner_maxima, row_sums


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=40), st.integers(1, 30), st.integers(0, 2))
def test_fold_never_exceeds_the_budget(costs, budget, sep):
    ids = chunking.fold(costs, budget, sep)
    assert len(ids) == len(costs) and ids == sorted(ids)
    for k in set(ids):
        own = [c for c, i in zip(costs, ids) if i == k]
        while len(own) > 1 and not own[0]:  # an item without cost is overwritten, so it takes no separator
            own = own[1:]
        assert sum(own) + sep * (len(own) - 1) <= budget or len(own) == 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=40), st.integers(1, 20), st.integers(0, 2), st.integers(0, 25))
def test_a_run_is_summed_up_for_any_state(costs, budget, sep, used):
    levels, after, breaks, total, fresh_used, fresh_breaks = chunking.carry(np.array(costs), budget, sep)
    state, chunk = used, 0
    for c in costs:
        state, chunk = chunking.step(state, chunk, c, budget, sep)
    at = int(np.searchsorted(levels, budget - used, "right"))
    if used == 0:
        assert (fresh_used, fresh_breaks) == (state, chunk)
    elif at == len(levels):
        assert (used + total, 0) == (state, chunk)
    else:
        assert (after[at], breaks[at]) == (state, chunk)
    assert len(levels) <= budget + 1


def test_long_keys_are_packed_over_many_files(spark):
    """One key with most of the rows, small ones, a null one: as the fold in order, though the key lies in several files."""
    r = np.random.default_rng(5)
    rows = [("hot", i, int(c)) for i, c in enumerate(r.integers(0, 30, 3000) * (r.random(3000) < 0.8))] + [("zeros", i, 0) for i in range(700)]
    rows += [(f"k{k}", i, int(r.integers(0, 60))) for k in range(50) for i in range(int(r.integers(1, 9)))] + [(None, i, 7) for i in range(400)] + [("gap", i, None if i % 2 else 9) for i in range(300)]
    items = spark.createDataFrame(rows, "k string, i int, c int").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for budget, sep in ((40, 0), (100, 1), (7, 2), (10**9, 1)):
            got = {}
            for x in chunking.chunk_ids(items, ["k"], "i", "c", budget, sep).collect():
                got.setdefault(x.k, {})[x.i] = x.chunk_id
            for k in {x[0] for x in rows}:
                own = [x[2] or 0 for x in sorted((x for x in rows if x[0] == k), key=lambda x: x[1])]
                assert [got[k][i] for i in range(len(own))] == chunking.fold(own, budget, sep), (k, budget)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert chunking.chunk_ids(items.limit(0), ["k"], "i", "c", 5).count() == 0


@pytest.mark.parametrize("long", [10**6, 100, 5])
def test_packing_of_short_and_long_keys(spark, monkeypatch, long):
    """Whole keys, runs of keys, and both at once give the fold's chunks: null keys, null texts and costs, two keys."""
    monkeypatch.setattr(chunking, "LONG", long)
    r = np.random.default_rng(9)
    sizes = {("hot", 1): 900, ("hot", 2): 40, ("a", 1): 5, (None, 1): 150, ("a", None): 6, ("zero", 3): 7}
    rows = [(*k, i, None if i % 11 == 3 else f"t{i}", 0 if k[0] == "zero" else None if i % 13 == 5 else int(r.integers(0, 30))) for k, n in sizes.items() for i in range(n)]
    items = spark.createDataFrame(rows, "k string, g int, i int, t string, c int").repartition(5)
    got = {(x.k, x.g, x.chunk_id): (x.chunk, x.n_items) for x in chunking.pack(items, ["k", "g"], "i", "t", "c", 70, sep=1, joiner="|").collect()}
    want = {}
    for k in sizes:
        own = [x for x in rows if x[:2] == k]
        for x, n in zip(own, chunking.fold([x[4] or 0 for x in own], 70, 1)):
            want.setdefault((*k, n), []).append(x[3])
    assert got == {k: ("|".join(t for t in v if t is not None), len(v)) for k, v in want.items()}
    assert chunking.pack(items.limit(0), ["k", "g"], "i", "t", "c", 70).count() == 0


def test_segments_hold_all_lines(spark):
    lines = spark.range(50).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("t"))
    marks = lines.where("i % 7 = 3").select("k", "i")
    got = chunking.cut(lines, marks, ["k"], "i", "t").orderBy("segment").collect()
    assert "\n".join(r.chunk for r in got) == "\n".join(f"l{i}" for i in range(50))
    assert sum(r.n_lines for r in got) == 50


def test_blocked_pairs_equal_a_matrix(spark):
    v = np.random.default_rng(0).standard_normal((70, 5))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(r.i, r.j): r.sim for r in all_pairs(rows, "id", "v", block=16).collect()}
    m = v @ v.T
    assert len(got) == 70 * 69 // 2 and all(abs(s - m[i, j]) < 1e-5 for (i, j), s in got.items())
    assert {p for p, s in got.items() if s > 1} == {(r.i, r.j) for r in all_pairs(rows, "id", "v", over=1.0, block=16).collect()}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=3, max_size=40))
def test_peaks_are_apart_and_high(values):
    x = np.array(values, float)
    p = series.peaks(x, 1.0, 3, 0)
    assert all(b - a >= 3 for a, b in zip(p, p[1:]))
    assert all(x[k] >= x[k - 1] and x[k] >= x[k + 1] for k in p)


def peaks_by_definition(x, prominence, distance, width):
    """Peaks one property at a time, each straight from its definition."""
    n, found, i = len(x), [], 1
    while i < n - 1:
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < n and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    kept = list(found)
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):  # the highest first, of equal ones the last
        if p in kept:
            kept = [q for q in kept if q == p or abs(q - p) >= distance]
    out = []
    for p in kept:
        left, right = p, p
        while left > 0 and x[left - 1] <= x[p]:
            left -= 1
        while right < n - 1 and x[right + 1] <= x[p]:
            right += 1
        drop = x[p] - max(min(x[left : p + 1]), min(x[p : right + 1]))
        if drop < prominence:
            continue
        level, a, b = x[p] - drop / 2, float(p), float(p)
        low = min(range(left, p + 1), key=lambda k: (x[k], -k))
        high = min(range(p, right + 1), key=lambda k: (x[k], k))
        k = p
        while k > low and x[k] > level:
            k -= 1
        a = k + (level - x[k]) / (x[k + 1] - x[k]) if x[k] < level else k
        k = p
        while k < high and x[k] > level:
            k += 1
        b = k - (level - x[k]) / (x[k - 1] - x[k]) if x[k] < level else k
        if b - a >= width:
            out.append(p)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-6, 6), min_size=1, max_size=30), st.sampled_from([0.05, 1, 3]), st.integers(1, 5), st.sampled_from([0, 1, 2]))
def test_peaks_match_their_definition(values, prominence, distance, width):
    x = np.array(values, float)
    assert series.peaks(x, prominence, distance, width).tolist() == peaks_by_definition(x, prominence, distance, width)


def test_peaks_take_time_in_proportion():
    """A rising and a falling zigzag, a monotone series and nested hills of 200,000 points."""
    n = 200_000
    i = np.arange(n)
    hills = np.zeros(n)
    for k in range(1, 17):
        hills += (np.abs((i % (n >> (k - 1))) - (n >> k)) < (n >> (k + 1))) / k
    for x in (i * 0.01 + (i % 2), -i * 0.01 + (i % 2), i * 1.0, hills, np.zeros(n)):
        t = time.perf_counter()
        series.peaks(x, 0.05, 3, 2)
        assert time.perf_counter() - t < 5


def test_nearest_in_blocks_equals_a_matrix(spark):
    v = np.random.default_rng(1).standard_normal((60, 4)).round(1)
    v[30:] = v[:30]  # ties
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {}
    for r in nearest(rows.where("id % 7 = 0"), rows, "id", "v", 5, block=16).collect():
        got.setdefault(r.q_id, {})[r.rk] = r.item
    m = (v @ v.T).round(6)
    for q in range(0, 60, 7):
        order = [int(i) for i in np.lexsort((np.arange(60), -m[q])) if i != q][:5]
        assert [got[q][k] for k in range(1, 6)] == order
    few = nearest(rows.where("id < 2"), rows.where("id < 2"), "id", "v", 5).collect()
    assert sorted((r.q_id, r.item) for r in few) == [(0, 1), (1, 0)]


def test_sums_and_maxima_by_blocks(spark):
    v = np.random.default_rng(3).standard_normal((50, 4))
    rows = spark.createDataFrame([(i % 2, i, x.tolist()) for i, x in enumerate(v)], "k int, id long, v array<double>")
    m = (v @ v.T).round(6)
    np.fill_diagonal(m, 0)
    for keys, ok in ((None, np.ones((50, 50), bool)), (["k"], np.add.outer(np.arange(50), np.arange(50)) % 2 == 0)):
        sums = {r.i: (r.n, r.total) for r in row_sums(rows, "id", "v", block=8, keys=keys).collect()}
        assert all(abs(sums[i][1] - (m * ok)[i].sum()) < 1e-9 and sums[i][0] == ok[i].sum() - 1 for i in range(50))
        best = {(r.src, r.dst): r.sim for r in owner_maxima(rows, "id", "v", lambda x: x // 10, block=8, keys=keys).groupBy("src", "dst").agg(F.max("sim").alias("sim")).collect()}
        assert best == {(a, b): np.where(ok, m, -9)[10 * a : 10 * a + 10, 10 * b : 10 * b + 10].max() for a in range(5) for b in range(a + 1, 5)}
        pairs = {(r.i, r.j) for r in all_pairs(rows, "id", "v", block=8, keys=keys).collect()}
        assert pairs == {(i, j) for i in range(50) for j in range(i + 1, 50) if ok[i, j]}
