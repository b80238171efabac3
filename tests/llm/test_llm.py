"""The training-data operators against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import fm_index, license_scan, line_dedup, ngram_join, packing, substring_dedup

SCHEMA = "doc_id long, text string, n_words long, k1 long, c string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact and near copies, repeated passages and lines, nulls, empties and a repeated row."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage, line = text(120), text(70), "This Line is on many pages, and long enough to count."
    rows = [(None, None), (1, None), (2, ""), (3, "one two"), (4, "one two"), (4, "one two"), (None, base)]
    rows += [(10 + i, base) for i in range(6)]
    for i in range(12):
        w = base.split()
        w[r.randrange(len(w))] = "edit%d" % i
        rows.append((30 + i, " ".join(w)))
    rows += [(60 + i, text(40) + " " + passage + " " + text(30)) for i in range(8)]
    rows += [(80 + i, text(20) + "\n  " + line.upper() + "\t\n" + text(5) + "\n" + line) for i in range(7)]
    rows += [(100, text(9000)), (101, passage + "  " + text(3))]
    return rows


@pytest.mark.parametrize("hot", [2, 100_000])
def test_line_dedup(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    ws = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(ws).translate(low)
    order = lambda i: -1 if i is None else i
    hold = defaultdict(set)
    for i, t in corpus:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                hold[key(x)].add(order(i))
    want = []
    for i, t in corpus:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(hold.get(key(x), ())) >= 5 and max(hold[key(x)]) != order(i))]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = [tuple(x) for x in line_dedup.digest(docs(spark, corpus)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(x[2] for x in want) > 10


def test_line_runs_are_merged(spark, corpus):
    from tessera.llm.common import Workspace, sorted_runs

    index = line_dedup.LineRuns(Workspace(spark, "t"), fanout=2)
    d = docs(spark, [x for x in corpus if x[0] is not None])
    fresh = [index.admit(d.where(f"doc_id % 3 = {k}")).count() for k in range(3)]
    assert sum(fresh) == index.repeated(1).count()
    assert len(index.levels) > 1
    with sorted_runs(spark):
        held = {(x.k1, x.k2): (x.n_docs, x.max_doc) for x in index.repeated(2).collect()}
        whole = {(x.k1, x.k2): (x.n_docs, x.max_doc) for x in line_dedup.sightings(d, 40).where("n_docs >= 2").collect()}
        assert held == whole and held
        batch = index.ws.write_sorted(line_dedup.sightings(d, 40), "batch", line_dedup.KEY)
        plan = batch.join(index.runs()[0].hint("merge"), line_dedup.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


@pytest.mark.parametrize(("words", "hot"), [(1, 1), (300, 3), (400_000, 100_000)])
def test_substring_dedup(spark, corpus, monkeypatch, words, hot):
    """Also with every shared seed crowded, level after level down to windows, and with every content hot."""
    monkeypatch.setattr(substring_dedup, "WORDS_PER_SHARD", words)
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    order = lambda i: -1 if i is None else i
    first = {}
    for i, t in sorted(corpus, key=lambda x: order(x[0])):
        w = (t or "").split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), order(i))
    want = []
    for i, t in corpus:
        w = (t or "").split()
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < order(i):
                gone |= set(range(k, k + 50))
        kept = [x for k, x in enumerate(w) if k not in gone]
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    got = [tuple(x) for x in substring_dedup.dedup(docs(spark, corpus), with_text=False).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(x[2] for x in want) > 500


def test_minima():
    r = np.random.default_rng(1)
    for n in (1, 5, 63, 64, 65, 1000, 5000):
        v = r.integers(0, 10**6, n).astype(np.int32)
        lo = r.integers(0, n, 400)
        hi = lo + 1 + (r.integers(0, 10**6, 400) % (n - lo))
        assert fm_index.Minima(v).of(lo, hi).tolist() == [int(v[a:z].min()) for a, z in zip(lo, hi)]


def test_fm_index_windows():
    r = np.random.default_rng(3)
    seqs = [r.integers(0, 6, r.integers(12, 60)) for _ in range(30)]
    values = np.arange(30)
    index = fm_index.FMIndex(seqs, values)
    width = 5
    got = set()
    for i, a, z in index.windows(np.arange(30), np.array([len(s) - width + 1 for s in seqs]), values, width):
        got |= {(i, k) for k in range(a, z + 1)}
    seen, want = set(), set()
    for i, s in enumerate(seqs):
        own = [tuple(s[k : k + width]) for k in range(len(s) - width + 1)]
        want |= {(i, k) for k, x in enumerate(own) if x in seen}
        seen |= set(own)
    assert got == want


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    label = {i: i for i, _ in rows if i is not None}
    change = True
    while change:
        change = False
        for (i, _), a in zip(rows, sets):
            for (j, _), b in zip(rows, sets):
                if None not in (i, j) and a and b and 4 * len(a & b) >= 3 * len(a | b) and label[i] > label[j]:
                    label[i] = label[j]
                    change = True
    return [(i, len(s), label.get(i)) for (i, _), s in zip(rows, sets)]


def test_ngram_join(spark, corpus):
    got = [tuple(x) for x in ngram_join.digest(docs(spark, corpus)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(corpus)))


def test_ngram_join_large_group(spark):
    r = random.Random(9)
    base = ["w%d" % r.randrange(10**6) for _ in range(90)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(90)] = "e%d" % r.randrange(10**6)
        rows.append((i, " ".join(w)))
    got = [tuple(x) for x in ngram_join.digest(docs(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_ngram_join_salted_shingles(spark, monkeypatch):
    """Short texts whose only common shingles are salted over the shards meet all the same."""
    monkeypatch.setattr(ngram_join, "HEAVY", 3)
    rows, want = [], {}
    for g in range(20):
        passage = " ".join(f"p{g}x{i}" for i in range(16))
        for k in range(2):
            rows.append((100 * g + k, f"{passage} s{g}a{k} s{g}b{k}"))
            want[100 * g + k] = 100 * g
        for k in range(2, 14):
            rows.append((100 * g + k, passage + " " + " ".join(f"l{g}a{k}b{i}" for i in range(40))))
            want[100 * g + k] = 100 * g + k
    assert {x.doc_id: x.component_id for x in ngram_join.digest(docs(spark, rows)).collect()} == want


def test_suffix_filter_never_overshoots():
    r = np.random.default_rng(5)
    for _ in range(400):
        p = np.unique(r.integers(0, 400, r.integers(0, 120)))
        q = np.unique(np.concatenate([r.permutation(p)[: len(p) * 3 // 4], r.integers(0, 400, r.integers(0, 60))]))
        true = len(np.setxor1d(p, q))
        assert ngram_join.apart(p, q, true) <= true
    assert ngram_join.apart(np.arange(0, 100), np.arange(100, 200), 10) > 10


@pytest.mark.parametrize("limits", [(2, 4), (64, 1024)])
def test_ngram_join_of_shared_passages(spark, monkeypatch, limits):
    """Documents put together from few passages: most are unlike, some are alike, and no shingle is their own."""
    monkeypatch.setattr(ngram_join, "PAIRED", limits[0])
    monkeypatch.setattr(ngram_join, "MEMBERS", limits[1])
    r = random.Random(12)
    passages = [" ".join("p%dw%d" % (k, i) for i in range(14)) for k in range(24)]
    rows = [(i, " ".join(passages[k] for k in r.sample(range(24), 5))) for i in range(150)]
    rows += [(1000 + i, t + " tail%d" % i) for i, t in rows[:20]] + [(2000 + i, t) for i, t in rows[:9]]
    got = [tuple(x) for x in ngram_join.digest(docs(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = corpus + [(200, "漢字 and ελλ  x\n\n y <|endoftext|> "), (201, " a  b\t\tc 12345 don't ")]
    got = packing.pack(docs(spark, rows)).collect()
    assert len({x.sequence_id for x in got}) == len(got) and {x.offset for x in got} == {0}
    want = []
    for i, t in rows:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 0], 0
        for n in packing.piece_lengths(len(ids), 1024):
            want.append((i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids), ids[at : at + n]))
            at += n
        assert at == len(ids)
    assert sorted(map(repr, want)) == sorted(repr((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens, x.ids)) for x in got)
    assert all(x.length == 2**x.bucket <= 1024 for x in got)


def test_license_scan(spark):
    rows = [(1, "a b c\nLicensed under the Apache License, Version 2.0.\nd"), (2, None), (3, ""), (4, "released under the mit license"), (4, "released under the mit license"), (5, "x " * 5000 + "Licensed under CC BY-NC 4.0. " + "y " * 50), (6, "under the license")]
    got = sorted(tuple(x) for x in license_scan.scan(docs(spark, rows)).collect())
    assert [(x[0], x[1], x[3]) for x in got] == [(1, "Apache-2.0", 3), (4, "MIT", 0), (5, "CC-BY-NC-4.0", 5000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT DISTINCT unnest($1) AS doc_id, unnest($2) AS text", [[r[0] for r in rows], [r[1] for r in rows]])
    assert sorted(con.sql(license_scan.oracle()).fetchall()) == got


@pytest.mark.parametrize("f", [line_dedup.digest, substring_dedup.dedup, ngram_join.digest, packing.pack, license_scan.scan])
def test_empty_tables(spark, f):
    assert f(docs(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [0, 10**6])
def test_components(spark, monkeypatch, limit):
    """Both ways: by rounds over the cluster, and in one task of bounded size."""
    from tessera.llm import components
    from tessera.llm.common import Workspace

    monkeypatch.setattr(components, "FOREST", limit)
    r = random.Random(6)
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    up = {x: x for p in links for x in p}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    d = spark.createDataFrame(links, "u long, v long")
    got = {x.node: x.comp for x in components.components(Workspace(spark, "t"), d).collect()}
    assert got == {k: v for k, v in up.items() if any(k in p and p[0] != p[1] for p in links)}


def test_word_hashes(monkeypatch):
    """Equal words have equal hashes wherever they stand, in texts of many pieces too, and others don't."""
    from tessera.llm import common

    r = random.Random(4)
    for piece in (1 << 20, 64):
        monkeypatch.setattr(common, "_PIECE", piece)
        seen = {}
        for _ in range(300):
            text = "".join(r.choice(["a", "B", "b", "ab", "ba", " ", "\n", "\t\x0b", "é", "漢", "x" * r.randint(1, 90)]) for _ in range(r.randint(0, 60))).encode()
            for fold, words in ((None, text.split()), (common.LOWER, text.lower().split())):
                got = common.hash_words(text, fold).tolist()
                assert len(got) == len(words)
                for w, h in zip(words, got):
                    assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen) > 1000
    assert len(common.hash_words(b"")) == 0 and len(common.hash_words(b" \n ")) == 0
