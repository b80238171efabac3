"""Small literal cases, one per semantic edge."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunking, graph, joins, series
from tessera.plans import evaluate
from tessera.plans.answer import overall, scores_by_category
from tessera.sources import dialogue


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x")).first()
    return row.x


def turn_table(spark, texts, speaker="A"):
    return spark.createDataFrame([(0, 0, i, "t0", speaker, t) for i, t in enumerate(texts)], "conv_id int, session_ord int, turn_ord int, date_time string, speaker string, text string")


def chunks(spark, texts, **kw):
    return [r.chunk for r in chunking.turn_chunks(turn_table(spark, texts), **kw).orderBy("block").collect()]


def test_tail_joins_without_line_end(spark):
    assert chunks(spark, list("abcde")) == ["A: a\nA: b", "A: c\nA: dA: e"]


def test_only_tail_and_blank_turns(spark):
    assert chunks(spark, ["a"]) == ["A: a"]
    assert chunks(spark, ["a", "  ", None, "b"]) == ["A: a\nA: b"]


def packed(spark, texts, budget, sep=0, joiner="\n"):
    rows = spark.createDataFrame([(0, i, t, len(t)) for i, t in enumerate(texts)], "k int, i int, t string, c int")
    return [r.chunk for r in chunking.pack(rows, ["k"], "i", "t", "c", budget, sep, joiner).orderBy("chunk_id").collect()]


def test_packing(spark):
    assert packed(spark, ["aaaa", "bbbb", "cccc"], 9, sep=1) == ["aaaa\nbbbb", "cccc"]
    assert packed(spark, ["aa", "b" * 20, "cc"], 9, sep=1) == ["aa", "b" * 20, "cc"]
    assert packed(spark, ["aaaaa", "bbbbb"], 10, sep=1) == ["aaaaa", "bbbbb"]
    assert packed(spark, ["aaaaa", "bbbbb"], 10) == ["aaaaa\nbbbbb"]


def test_sentences(spark):
    assert one(spark, X.turn_sentences(F.col("t")), t="A: one! two? tail") == ["A:one!", "A:two?"]
    assert one(spark, X.turn_sentences(F.col("t"), 30), t="x" * 29) == []
    assert one(spark, X.turn_sentences(F.col("t"), 30), t="x" * 30) == ["x" * 30]
    rows = spark.createDataFrame([(1, "a" * 35 + "; " + "b" * 35 + "."), (2, "S: " + "a" * 35 + "; " + "b" * 35 + ".")], "k int, t string")
    assert [r.k for r in X.graph_sentences(rows, ["k"], "t").orderBy("k").collect()] == [1, 1, 2]


def test_images_and_speakers(spark):
    assert one(spark, X.strip_speaker(X.remove_image(F.col("t"))), t="Ann: hello ,image: a cat") == "hello"
    assert one(spark, X.turn_with_image(F.lit("A"), F.lit(" x "), F.lit("u"), F.lit("q"))) == "A:x,image:q"
    assert one(spark, X.turn_with_image(F.lit("A"), F.lit(" "), F.lit(None).cast("string"), F.lit("q"))) == "A:"


def test_cut(spark):
    t = turn_table(spark, list("abcd")).withColumn("line", F.col("text"))
    at = lambda *b: spark.createDataFrame([(0, x) for x in b], "conv_id int, turn_ord int")
    cut = lambda *b: [r.chunk for r in chunking.cut(t, at(*b), ["conv_id"], "turn_ord", "line").orderBy("segment").collect()]
    assert cut(0, 2, 2) == ["a\nb", "c\nd"]
    assert cut(9) == ["a\nb\nc\nd"]


def test_times(spark):
    body = spark.createDataFrame([(0, 0, "first", "hello\nworld"), (0, 1, "second", "hello")], "conv_id int, session_ord int, date_time string, body string")
    c = spark.createDataFrame([(0, 0, 0, "A: hello"), (0, 0, 1, "A: changed"), (0, 0, 2, "A: ,image: x")], "conv_id int, session_ord int, block int, chunk string")
    got = {r.chunk: r.timestamp for r in joins.attach_times(c, body).collect()}
    assert got == {"A: hello": "first", "A: changed": None, "A: ,image: x": "first"}


def test_json(spark):
    f = lambda t: one(spark, X.json_field(X.extract_json(F.col("t")), "$.a", "string"), t=t)
    assert f('text ```json {"a": "1"} ``` more') == "1"
    assert f('say {"a": "2"} now') == "2"
    assert one(spark, X.extract_json(F.col("t")).isNull(), t='x {"a":{"b":1}} y')


def test_edges_are_strict(spark):
    t = spark.createDataFrame([(0, 1, 0.7), (0, 2, 0.75), (1, 2, 0.71)], "src int, dst int, text_similarity double")
    s = spark.createDataFrame([(0, 1, 0.8), (0, 2, 0.9)], "src int, dst int, sentence_similarity double")
    got = {(r.src, r.dst): (r.edge_type, r.weight) for r in graph.typed_edges(t, s, []).collect()}
    assert got == {(0, 2): ("both", 0.9), (1, 2): ("text_similarity", 0.71)}


def test_series(spark):
    rows = spark.createDataFrame([(0, i, 3.0) for i in range(3)], "k int, i int, v double")
    assert [r.smooth for r in series.smooth3(rows, ["k"], ["i"], "v").orderBy("i").collect()] == [2.0, 3.0, 2.0]
    x = series.peaks(__import__("numpy").array([0, 1, 3, 3, 1, 0, 0.01, 0]), 0.05, 3, 2)
    assert x.tolist() == [2]


def test_pagerank_sums_to_one(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node int")
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0)], "src int, dst int, weight double")
    seeds = spark.createDataFrame([(7, 0, 1.0)], "q_id int, node int, p double")
    x = graph.personalized_pagerank(nodes, graph.symmetric(e, []), seeds, bound=1e-11).collect()
    assert abs(sum(r["rank"] for r in x) - 1) < 1e-9


def test_pagerank_solves_the_equations(spark):
    """Ranks against a linear solve, for two questions over a graph with loose nodes and a part no walk reaches."""
    r = np.random.default_rng(2)
    n = 24
    edges = {(int(min(a, b)), int(max(a, b))): float(w) for a, b, w in zip(r.integers(0, 18, 40), r.integers(0, 18, 40), r.uniform(0.1, 1, 40)) if a != b} | {(20, 21): 1.0}
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node int")
    e = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src int, dst int, weight double")
    marks = {1: {0: 0.5, 5: 0.5}, 2: {3: 0.25, 19: 0.75}}
    seeds = spark.createDataFrame([(q, k, p) for q, s in marks.items() for k, p in s.items()], "q_id int, node int, p double")
    got = {(x.q_id, x.node): x["rank"] for x in graph.personalized_pagerank(nodes, graph.symmetric(e, []), seeds, bound=1e-10).collect()}
    m = np.zeros((n, n))
    for (a, b), w in edges.items():
        m[a, b] = m[b, a] = w
    for q, s in marks.items():
        v = np.zeros(n)
        v[list(s)] = list(s.values())
        walk = np.array([m[i] / m[i].sum() if m[i].sum() else v for i in range(n)])
        want = np.linalg.solve(np.eye(n) - 0.85 * walk.T, 0.15 * v)
        assert all(abs(got.get((q, i), 0.0) - want[i]) < 1e-8 for i in range(n))
        assert not any((q, i) in got for i in (20, 21, 22, 23))
    with pytest.raises(RuntimeError):
        graph.personalized_pagerank(nodes, graph.symmetric(e, []), seeds, bound=1e-10, most_rounds=4)


def test_pushes_stay_near_the_seeds(spark, monkeypatch):
    """On a ring of 400 nodes the bound keeps walks near their seed, and every rank within the bound of the exact one. Adjacency rows may be cut."""
    n, bound = 400, 1e-3
    nodes = spark.range(n).select(F.col("id").alias("node"))
    e = spark.range(n).select(F.col("id").alias("src"), F.pmod(F.col("id") + 1, F.lit(n)).alias("dst"), F.lit(2.0).alias("weight"))
    hub = spark.range(2, 12).select(F.lit(0).cast("long").alias("src"), (F.col("id") * 30).alias("dst"), F.lit(1.0).alias("weight"))
    seeds = spark.createDataFrame([(1, 200, 1.0), (2, 0, 0.5), (2, 100, 0.5), (3, 399, 1.0)], "q_id int, node long, p double")
    m = np.zeros((n, n))
    for x in e.unionByName(hub).collect():
        m[x.src, x.dst] = m[x.dst, x.src] = x.weight
    total = m.sum(1)
    for piece in (1000, 3):
        monkeypatch.setattr(graph, "PIECE", piece)
        got = {(x.q_id, x.node): x["rank"] for x in graph.personalized_pagerank(nodes, graph.symmetric(e.unionByName(hub), []), seeds, bound=bound).collect()}
        for q, own in ((1, {200: 1.0}), (2, {0: 0.5, 100: 0.5}), (3, {399: 1.0})):
            v = np.zeros(n)
            v[list(own)] = list(own.values())
            want = np.linalg.solve(np.eye(n) - 0.85 * (m / total[:, None]).T, 0.15 * v)
            assert all(-1e-12 <= want[i] - got.get((q, i), 0.0) <= bound * total[i] for i in range(n))
        assert 5 < sum(q == 1 for q, _ in got) < 60
    assert graph.personalized_pagerank(nodes, graph.symmetric(e, []), seeds.limit(0)).count() == 0


def test_whole_ranks_reach_every_node(spark, monkeypatch):
    """Ranks of the linear solve on all of a ring with spokes, whatever their size; a seed without edges gives its mass back."""
    n = 60
    nodes = spark.range(n + 1).select(F.col("id").alias("node"))
    e = spark.range(n).select(F.col("id").alias("src"), F.pmod(F.col("id") + 1, F.lit(n)).alias("dst"), F.lit(2.0).alias("weight"))
    hub = spark.range(2, 12).select(F.lit(0).cast("long").alias("src"), (F.col("id") * 4).alias("dst"), F.lit(1.0).alias("weight"))
    seeds = spark.createDataFrame([(1, 30, 1.0), (2, 0, 0.5), (2, n, 0.5)], "q_id int, node long, p double")
    m = np.zeros((n + 1, n + 1))
    for x in e.unionByName(hub).collect():
        m[x.src, x.dst] = m[x.dst, x.src] = x.weight
    for piece in (1000, 3):
        monkeypatch.setattr(graph, "PIECE", piece)
        got = {(x.q_id, x.node): x["rank"] for x in graph.whole_pagerank(nodes, graph.symmetric(e.unionByName(hub), []), seeds).collect()}
        for q, own in ((1, {30: 1.0}), (2, {0: 0.5, n: 0.5})):
            v = np.zeros(n + 1)
            v[list(own)] = list(own.values())
            walk = np.array([m[i] / m[i].sum() if m[i].sum() else v for i in range(n + 1)])
            want = np.linalg.solve(np.eye(n + 1) - 0.85 * walk.T, 0.15 * v)
            assert all(abs(got.get((q, i), 0.0) - want[i]) < 1e-10 for i in range(n + 1))
    assert sum(q == 1 for q, _ in got) == n


def test_edges_in_buckets_are_not_moved(spark):
    """Neighbours of a frontier by a sort-merge join: only the frontier is exchanged, and the rows are those of plain edges."""
    from tessera.plans import storage

    e = spark.range(500).select(F.col("id").alias("src"), (F.col("id") * 7 % 500).alias("dst"), F.lit(1.0).alias("weight"))
    sym = graph.symmetric(e, [])
    stored = storage.bucketed(sym, "edges", "node")
    front = spark.range(0, 500, 3).select((F.col("id") % 4).alias("q_id"), F.col("id").alias("node"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        join = front.join(stored, "node")
        plan = join._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
        assert front.join(sym, "node")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") > 1
        got = sorted(map(tuple, graph.unvisited_neighbors(front, front, stored, []).collect()))
        assert got == sorted(map(tuple, graph.unvisited_neighbors(front, front, sym, []).collect())) and got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    storage.remove(stored)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("edges_")]


def test_anchors_are_looked_up_by_their_rarest_words(spark):
    """Times equal those of a search in every session; hardly any session is looked at in vain."""
    import random

    r = random.Random(1)
    word = lambda: r.choice("red blue sun sea tide sail rope mast deck wind storm port".split())
    bodies = [(c, s, f"day {s}", " ".join(word() for _ in range(60))) for c in range(4) for s in range(25)]
    chunks = []
    for c in range(4):
        for k in range(30):
            body = r.choice([b for b in bodies if b[0] == c])[3]
            at = r.randrange(len(body) - 40)
            chunks.append((c, 0, k, "Ann: " + r.choice([body[at : at + 40], body[at : at + r.randrange(1, 12)], "rope not there at all", " ".join(word() for _ in range(6))])))
        chunks.append((c, 0, 99, None))
    b = spark.createDataFrame(bodies, "conv_id int, session_ord int, date_time string, body string")
    ch = spark.createDataFrame(chunks, "conv_id int, session_ord int, block int, chunk string")
    got = {(x.conv_id, x.block): (x.anchor, x.timestamp) for x in joins.attach_times(ch, b).collect()}
    assert got == {(x.conv_id, x.block): (x.anchor, x.timestamp) for x in joins.attach_times(ch, b, direct=100).collect()}
    assert len(got) == len(chunks)
    for (c, k), (anchor, time) in got.items():
        hits = [s for q, s, _, body in bodies if q == c and anchor is not None and anchor in body]
        assert time == (f"day {min(hits)}" if hits else None), (c, k, anchor)
    own = ["conv_id", "session_ord", "block"]
    long_ = joins.attach_times(ch, b).select(*own, "anchor").where(F.size(F.split("anchor", " ")) > 4)
    tried = joins.holders(long_, b.withColumnRenamed("session_ord", "__s"), "conv_id", own).count()
    assert tried < 0.4 * long_.count() * 25


def test_contexts_stay_bounded(spark):
    lines = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("i"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("t"))
    got = {x.i: x.context for x in series.rolling(lines, ["k"], "i", "t", 4).collect()}
    assert got[4] == "l0\nl2\nl4" and got[6] == "l0\nl2\nl4\nl6" and got[2999] == "(1496 earlier lines)\nl2993\nl2995\nl2997\nl2999"
    assert max(map(len, got.values())) < 60


def test_scores(spark):
    rows = spark.createDataFrame([(4, 80.0), (4, None), (1, 60.0), (9, 10.0)], "label int, rating double")
    assert {r.category: r.rating for r in scores_by_category(rows).collect()} == {"single-hop": 80.0, "multi-hop": 60.0, "Unknown": 10.0}
    o = overall(rows).first()
    assert (o.macro, o.micro, o.errors) == (50.0, 50.0, 1)


def test_recall(spark):
    ranked = spark.createDataFrame([("x", 0, 1, "has t1"), ("x", 0, 2, "none"), ("x", 1, 1, "z")], "kind string, q int, rk int, chunk string")
    truth = spark.createDataFrame([(0, 0, "t1"), (0, 1, "t2")], "q int, t_ord int, truth string")
    got = {r.k: r.recall for r in evaluate.recall_at_k(ranked, truth, ["kind"], "q", (1, 3)).collect()}
    assert got == {1: 0.25, 3: 0.25}


def test_dialogue_json(spark, tmp_path):
    import json

    data = [{"conversation": {"session_1": [{"speaker": "A", "text": "hi", "dia_id": "D1"}], "session_1_date_time": "noon", "session_2_date_time": "later"}, "qa": [{"question": "q", "answer": "a", "category": 1, "evidence": ["D1"]}, {"question": "r"}]}]
    (tmp_path / "d.json").write_text(json.dumps(data))
    d = dialogue.read_dialogues(spark, str(tmp_path / "d.json"))
    s = dialogue.sessions(d)
    assert [(r.session_key, r.date_time, len(r.turns)) for r in s.orderBy("session_ord").collect()] == [("session_1", "noon", 1), ("session_2", "later", 0)]
    q = dialogue.questions(d)
    assert [r.question for r in q.collect()] == ["q"]
    assert joins.resolve_evidence(q, dialogue.turns(s)).first().evidence == ["hi"]


def test_graph_round_trip(spark, tmp_path):
    n = spark.createDataFrame([(0, "a")], "node int, content string")
    e = spark.createDataFrame([(0, 1, 1.0)], "src int, dst int, weight double")
    dialogue.save_graph(n, e, str(tmp_path))
    n2, e2 = dialogue.load_graph(spark, str(tmp_path))
    assert n2.collect() == n.collect() and e2.collect() == e.collect()


def test_best_ranks_move_no_edges(spark, monkeypatch):
    """The best of the linear solve's ranks, in parts, with loose seeds, repeated edges, hubs and parts no walk reaches; no edge is exchanged. Too large a graph goes by joins, with the same rows."""
    from tessera.plans import storage

    r = np.random.default_rng(3)
    n = 70
    pairs = [(int(a), int(b), round(float(w), 6)) for a, b, w in zip(r.integers(0, 60, 150), r.integers(0, 60, 150), r.uniform(0.1, 1, 150)) if a != b] + [(0, i, 0.5) for i in range(1, 50)] + [(62, 63, 1.0), (62, 63, 0.25)]
    name = lambda i: 1000 + 7 * i
    nodes = spark.createDataFrame([(name(i),) for i in range(n)], "node long")
    e = storage.written(spark.createDataFrame([(name(a), name(b), w) for a, b, w in pairs], "src long, dst long, weight double"), "graph")
    marks = {q: {int(x): 1 / 3 for x in r.choice(66, 3, replace=False)} for q in range(40)} | {50: {65: 0.5, 66: 0.5}, 51: {62: 1.0}}
    seeds = storage.written(spark.createDataFrame([(q, name(k), p) for q, s in marks.items() for k, p in s.items()], "q_id long, node long, p double"), "marks")
    m = np.zeros((n, n))
    for a, b, w in pairs:
        m[a, b] += w
        m[b, a] += w
    reach = np.linalg.matrix_power(np.eye(n) + (m > 0), 64) > 0
    want = []
    for q, s in marks.items():
        v = np.zeros(n)
        v[list(s)] = list(s.values())
        walk = np.array([m[i] / m[i].sum() if m[i].sum() else v for i in range(n)])
        rank = np.round(np.linalg.solve(np.eye(n) - 0.85 * walk.T, 0.15 * v), 6)
        best = sorted((-rank[i], i) for i in range(n) if any(reach[i, j] for j in s))[:4]
        want += [(q, name(i), -x, k + 1) for k, (x, i) in enumerate(best)]
    plans, kept = [], storage.written
    monkeypatch.setattr(graph, "written", lambda df, name: plans.append((df.rdd.getNumPartitions(), df._jdf.queryExecution().executedPlan().toString())) or kept(df, name))
    for piece, wide in ((1000, 64), (2, 3)):
        monkeypatch.setattr(graph, "PIECE", piece)
        monkeypatch.setattr(graph, "WIDE", wide)
        assert sorted(map(tuple, graph.top_ranks(nodes, e, seeds, 4).collect())) == sorted(want)
    assert len(plans) == 2 and all(k == 3 and "Exchange" not in p for k, p in plans)
    assert graph.top_ranks(nodes, e, seeds.limit(0), 4).count() == 0 and graph.top_ranks(nodes, e.limit(0), seeds, 4).where("rank = 0.5").count() == 2
    monkeypatch.setattr(graph, "HELD", 5)
    few = seeds.where("q_id in (3, 50, 51)")
    assert sorted(map(tuple, graph.top_ranks(nodes, e, few, 4).collect())) == sorted(x for x in want if x[0] in (3, 50, 51))
