"""Toxicity: held-out accuracy, and the label model against votes drawn with known accuracies and correlations."""

import random
import zlib

import numpy as np
import pytest

from tessera.llm import toxicity


def test_toxicity(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmn") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(900):
        w = [word() for _ in range(r.randint(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            w[r.randrange(len(w))] = r.choice(["zzvile", "zzfoul", "qqnasty" + word()])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic), 1))
    rows += [(None, None), (5000, ""), (5001, None)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, score int")
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score long, said string")
    model = toxicity.train(d, lab)
    got = toxicity.score(d, model).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 900]
    assert all(zlib.crc32(str(x.doc_id).encode()) % 5 == 0 for x in held) and len(held) > 100
    assert sum(x.predicted != (x.doc_id % 5 == 0) for x in held) <= 0.05 * len(held)
    kept = toxicity.reject_toxic(d, model)
    assert kept.columns == d.columns and 700 <= kept.count() <= 740
    assert toxicity.train(d, lab.limit(0)).weights == {}
    assert toxicity.score(d.limit(0), model).count() == 0 and toxicity.train(d.limit(0), lab).weights == {}


@pytest.mark.parametrize("seed", range(4))
def test_label_model_finds_accuracies_and_correlations(seed):
    r = np.random.default_rng(seed)
    n, accuracy, says = 8000, [0.9, 0.8, 0.75, 0.85, 0.7, 0.8], [0.6, 0.5, 0.7, 0.4, 0.8, 0.5]
    y = r.random(n) < 0.3
    votes = np.full((n, 8), -1, np.int8)
    for j, (a, c) in enumerate(zip(accuracy, says)):
        say, right = r.random(n) < c, r.random(n) < a
        votes[say, j] = np.where(right, y, ~y)[say]
    for j in (6, 7):  # repeat the fifth voter, but for some abstentions
        votes[:, j] = np.where(r.random(n) < 0.05, -1, votes[:, 4])
    model = toxicity.LabelModel()
    p = model.fit(votes)
    assert np.abs(model.accuracy - [*accuracy, 0.7, 0.7]).max() < 0.04 and abs(model.balance - 0.3) < 0.03
    assert model.correlation[4, 6] > 0.8 and model.correlation[6, 7] > 0.8 and model.correlation[:4].max() == 0
    best = np.zeros(n)  # what one knows who knows the voters
    for j, a in enumerate(accuracy):
        best += np.log(a / (1 - a)) * ((votes[:, j] == 1).astype(int) - (votes[:, j] == 0))
    bayes = ((best + np.log(0.3 / 0.7) > 0) == y).mean()
    assert ((p > 0.5) == y).mean() > bayes - 0.02


def test_long_and_equal_texts(spark):
    rows = [(i, "good words here " * 10 if i % 3 else "zzvile words here", 0) for i in range(300)]
    rows += [(1000, "good " * 300_000, 0), (1001, "good " * 300_000 + "zzvile", 0), (1002, "x" * 1_000_000, 0), (1, "good words", 0), (1, "good words", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(d, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int"))
    got = toxicity.score(d, model).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x.predicted for x in got}
    assert by[1000] == 0 and by[1001] == 1 and by[1002] == 0 and by[3] == 1 and by[4] == 0
    assert len({(x.score, x.predicted) for x in got if x.doc_id % 3 == 0 and x.doc_id < 300}) == 1


def test_posterior_beats_its_voters(spark, monkeypatch):
    """On the table of documents the label model is more often right than its best voter and than the majority of the votes."""
    seen = {}
    fit = toxicity.LabelModel.fit

    def keep(self, votes):
        seen["votes"], seen["p"] = votes, fit(self, votes)
        return seen["p"]

    monkeypatch.setattr(toxicity.LabelModel, "fit", keep)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    s = toxicity.sample(docs, labels, 6000)
    toxicity.fit(s)
    y, votes = s.toxic == 1, seen["votes"]
    right = lambda guess: (guess == y).mean()
    voters = max(right(votes[:, j] == 1) for j in range(votes.shape[1]))
    majority = right((votes == 1).sum(1) > (votes == 0).sum(1))
    assert right(seen["p"] >= 0.5) > max(voters, majority) + 0.01


def test_scores_by_brute_force(spark):
    """Every document's score from its text alone: the weights of all its words and stems, added up anew."""
    import math

    from tessera.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {}
    for x in docs.collect():
        words = set(toxicity._WORD.findall((x.text or "").lower()))
        parts = {w + "." for w in words} | {w[:k] for w in words for k in (4, 5, 6) if len(w) >= k}
        z = model.bias + math.fsum(model.weights.get(p, 0.0) for p in parts)
        want[x.doc_id] = 1 / (1 + math.exp(-z)) if z > -30 else 0.0
    got = {x.doc_id: x for x in queries.op3_toxicity(spark, sf).collect()}
    assert set(got) == set(want)
    for i, x in got.items():
        assert abs(x.score - want[i]) < 1e-9 and x.predicted == int(x.score >= 0.5)
        assert x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
