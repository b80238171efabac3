"""The permutation against a plain network, shards against their law, ties and edge cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding


def plain_place(number, n, seed):
    """One number at a time, with Python's integers."""
    bits = 1
    while 4**bits < n:
        bits += 1
    while True:
        left, right = divmod(number, 1 << bits)
        for key in sharding.round_keys(seed):
            z = (right ^ key) * sharding.MULTIPLIER % 2**64
            z = (z ^ (z >> 32)) * sharding.MULTIPLIER % 2**64
            left, right = right, left ^ ((z >> 32) % (1 << bits))
        number = (left << bits) + right
        if number < n:
            return number


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4096, 4097])
def test_permutation(n):
    for seed in (1, 2):
        got = sharding.permute(np.arange(n), n, seed)
        assert got.tolist() == [plain_place(k, n, seed) for k in range(n)]
        assert sorted(got.tolist()) == list(range(n))
        assert sharding.permute(got, n, seed, back=True).tolist() == list(range(n))
    assert len(sharding.permute(np.arange(0), 0, 1)) == 0


def test_large_numbers_and_spread():
    n = 10**15 + 7
    x = np.random.default_rng(0).integers(0, n, 2000)
    y = sharding.permute(x, n, 1)
    assert y.min() >= 0 and y.max() < n and sharding.permute(y, n, 1, back=True).tolist() == x.tolist()
    y = sharding.permute(np.arange(40_000), 40_000, 1)
    runs = np.bincount(y[:4000] % 40, minlength=40)  # the first tenth of the rows lies about evenly
    assert runs.min() > 60 and runs.max() < 140
    assert abs(np.corrcoef(np.arange(40_000), y)[0, 1]) < 0.02
    assert (np.diff(y) == 1).sum() < 10


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = [(i, "".join(r.choice("ab é\n") for _ in range(r.randrange(60)))) for i in range(300)]
    out += [(1000 + i, "one text that many rows hold") for i in range(200)]
    out += [(7, "another text of document 7"), (8, out[8][1]), (8, out[8][1])]  # a repeated id, repeated rows
    out += [(None, None), (None, ""), (None, None), (2000, None), (2001, ""), (2002, "long é " * 200_000)]
    r.shuffle(out)
    return out


def test_shards_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in sharding.digest(docs.repartition(5), shards=7).collect()]
    assert Counter((i, s, c) for i, s, c, *_ in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {x[3] for x in got} == {"rows"} and {x[6] for x in got} == {None}
    by = {k: sorted(x[5] for x in got if x[4] == k) for k in range(7)}
    assert all(slots == list(range(len(slots))) for slots in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = [tuple(x) for x in sharding.digest(docs.coalesce(1), shards=7).collect()]
    assert Counter(again) == Counter(got)  # whatever the partitions
    assert Counter(map(repr, sharding.digest(docs, shards=7, seed=2).collect())) != Counter(map(repr, sharding.digest(docs, shards=7).collect()))
    n, order = len(rows), sorted({i for i, _ in rows if i is not None})
    only = [x for x in got if x[0] is not None and sum(i == x[0] for i, _ in rows) == 1]
    first = {i: sum(a is None or a < i for a, _ in rows) for i in order}
    for i, _, _, _, shard, slot, _ in only:
        assert slot * 7 + shard == plain_place(first[i], n, 1)
        assert sharding.row_at(shard, slot, n, 7, 1) == first[i]
    with pytest.raises(IndexError):
        sharding.row_at(0, n, n, 7, 1)


def test_rows_alike_may_fill_a_third(spark):
    """Rows that are equal in all columns are still dealt out one by one, over several files."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shuffle(docs, 10).collect()
    assert sorted((x.shard, x.slot) for x in got) == [(s, k) for s in range(10) for k in range(300)]
    held = Counter(x.shard for x in got if x.doc_id == 5)
    assert min(held.values()) > 60


def test_edges(spark, tmp_path):
    assert sharding.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    names = "row number place file at start id hash size".split()
    docs = spark.createDataFrame([(i, "t", *[f"{n}{i}" for n in names], "mine", {"k": i}) for i in range(5)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names) + ", shard string, m map<string,int>")
    out = sharding.shuffle(docs, 2)
    got = sorted(out.collect())
    assert out.columns == ["doc_id", "text", *names, "m", "shard", "slot"]
    assert [tuple(x)[2:-3] for x in got] == [tuple(f"{n}{i}" for n in names) for i in range(5)] and [x.m for x in got] == [{"k": i} for i in range(5)]
    assert sorted(Counter(x.shard for x in got).values()) == [2, 3]
    sharding.write(out, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((x.doc_id, x.shard, x.slot) for x in back.collect()) == sorted((x.doc_id, x.shard, x.slot) for x in got)
    with pytest.raises(ValueError):
        sharding.shuffle(docs, 0)
