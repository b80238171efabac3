"""Kneser-Ney perplexities and thresholds against a plain model."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import quality_lm


class Plain:
    """Interpolated modified Kneser-Ney by its definition, over tuples of words."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = {n: defaultdict(int) for n in range(1, order + 1)}
        for t in texts:
            w = ["<s>", *t.split(), "</s>"]
            for n in range(2, order + 1):
                for k in range(len(w) - n + 1):
                    if n == order or k == 0:
                        self.counts[n][tuple(w[k : k + n])] += 1
        for n in range(order, 1, -1):
            for g in self.counts[n]:
                self.counts[n - 1][g[1:]] += 1
        self.cut = {n: self.discounts(list(c.values())) for n, c in self.counts.items()}
        self.context = {n: defaultdict(list) for n in range(2, order + 1)}
        for n in range(2, order + 1):
            for g, k in self.counts[n].items():
                self.context[n][g[:-1]].append(k)
        low, words = self.cut[1], self.counts[1]
        self.total = sum(words.values())
        self.spare = sum(low[min(x, 3) - 1] for x in words.values()) / self.total / (len(words) + 1)

    @staticmethod
    def discounts(numbers):
        n = [max(sum(x == k for x in numbers), 0.5) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(v, a), b) for v, a, b in zip((1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]), (0.1, 0.2, 0.3), (0.95, 1.9, 2.9))]

    def prob(self, gram):
        n = len(gram)
        k, d = self.counts[n].get(gram, 0), self.cut[n]
        seen = k - d[min(k, 3) - 1] if k else 0
        if n == 1:
            return seen / self.total + self.spare
        context = self.context[n].get(gram[:-1])
        if not context:
            return self.prob(gram[1:])
        return (max(seen, 0) + sum(d[min(x, 3) - 1] for x in context) * self.prob(gram[1:])) / sum(context)

    def perplexity(self, text):
        w = ["<s>", *text.split(), "</s>"]
        return math.exp(-sum(math.log(self.prob(tuple(w[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(w))) / (len(w) - 1))


def corpus(r, n=240):
    vocabulary = ["w%d" % k for k in range(60)]
    rows, labels = [], []
    for i in range(n):
        w = [vocabulary[min(59, int(r.expovariate(0.1)))] for _ in range(r.randint(1 if i % 20 == 0 else 8, 40))]
        if i % 8 == 7:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "en" if i % 2 else None))
        if i % 8 != 7:
            labels.append((i, 1, 9))
    return rows + [(None, None, "en"), (900, "", "en"), (901, "w1 w2", "xx"), (902, " \n ", "xx")], labels


@pytest.mark.parametrize("order", [2, 3, 4])
def test_perplexities_and_thresholds(spark, order):
    rows, labels = corpus(random.Random(8))
    d = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, lang string, n long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, n int")
    got = {x.doc_id: x for x in quality_lm.score(d, lab, order=order, batches=2, quantile=0.9).collect()}
    assert len(got) == len(rows)
    half = {x.doc_id for x in d.selectExpr("doc_id", "pmod(xxhash64(doc_id, 3), 2) = 0 AS t").collect() if x.t}
    good = {x[0] for x in labels}
    plain = Plain([t for i, t, _ in rows if i in half & good], order)
    want = {i: plain.perplexity(t) for i, t, _ in rows if t and t.strip()}
    for i, p in want.items():
        assert abs(got[i].perplexity / p - 1) < 1e-6, i
    edge = {}
    for lang in ("en", None, "all"):
        known = sorted(want[i] for i, t, x in rows if i in good - half and i in want and lang in (x, "all"))
        edge[lang] = known[math.ceil(0.9 * len(known)) - 1]
    for i, _, lang in rows:
        t = edge[lang] if lang in edge else edge["all"]
        assert 1 <= got[i].threshold / t * (1 + 1e-9) and got[i].threshold / t < 1 + 1.01 * quality_lm.BIN
        assert got[i].keep == (i in want and want[i] <= got[i].threshold)
    assert not any(x.keep for x in quality_lm.score(d, lab.limit(0)).collect())
    assert quality_lm.score(d.limit(0), lab).count() == 0


def test_a_word_in_every_place(spark, monkeypatch):
    """Half of all words are one word, in one block of text after another: no shard gets more than others, and the numbers hold."""
    monkeypatch.setattr(quality_lm, "POSITIONS", 500)
    r = random.Random(3)
    texts = [" ".join("the" if k % 2 else "w%d" % r.randrange(3000) for k in range(60)) for _ in range(200)] + ["the " * 5000]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    dealt = quality_lm._deal(d.repartition(1), 3, 16, True).collect()
    per = defaultdict(int)
    for row in dealt:
        per[row.shard] += len(quality_lm._of(bytes(row.blob))[0])
    assert max(per.values()) < 1.3 * sum(per.values()) / 16
    asked = quality_lm._ask(d.repartition(1).selectExpr("doc_id", "lang", "false AS unseen", "text"), 3, 16).where("shard is not null").collect()
    per = defaultdict(int)
    for row in asked:
        per[row.shard] += len(quality_lm._of(bytes(row.blob))[1])
    assert max(per.values()) < 1.3 * sum(per.values()) / 16
    lab = spark.createDataFrame([(i, 1) for i in range(len(texts))], "doc_id long, quality int")
    got = {x.doc_id: x.perplexity for x in quality_lm.score(d, lab, order=3).collect()}
    half = {x.doc_id for x in d.selectExpr("doc_id", "pmod(xxhash64(doc_id, 3), 2) = 0 AS t").collect() if x.t}
    plain = Plain([t for i, t in enumerate(texts) if i in half], 3)
    assert all(abs(got[i] / plain.perplexity(texts[i]) - 1) < 1e-6 for i in list(range(0, 200, 9)) + [200])


def test_ties_at_the_threshold_stay(spark):
    d = spark.createDataFrame([(i, "a b c d", "en") for i in range(40)] + [(50, "zz yy", "en")], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    got = {x.doc_id: x.keep for x in quality_lm.score(d, lab, quantile=0.5).collect()}
    assert all(got[i] for i in range(40)) and not got[50]


def test_packed_arrays_are_small_and_whole():
    """What shards write and send comes back as it was, and a trigram takes a third of its three hashes, an asked hash less than seven bytes."""
    r = np.random.default_rng(4)
    words = r.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    grams = words[np.minimum(r.geometric(0.002, (30_000, 3)), 4999)]
    grams = grams[np.lexsort(grams.T[::-1])]
    asked = np.sort(r.integers(0, 1 << 60, 30_000, dtype=np.uint64)) * np.uint64(12) + np.uint64(5)
    many = r.geometric(0.9, 30_000).astype(np.uint32)
    for arrays in ([grams, many], [np.array([2]), asked], [asked[:0], many[:0]], [grams[:0], many[:0]], [asked[:1]], [asked[::-1]], [np.array([-1, 2**62])]):
        got = quality_lm._of(quality_lm._arrays(*arrays))
        assert len(got) == len(arrays)
        assert all(a.dtype == b.dtype and a.shape == b.shape and (a == b).all() for a, b in zip(arrays, got))
    assert len(quality_lm._arrays(grams, many)) < 8 * len(grams)
    assert len(quality_lm._arrays(np.array([2]), asked)) < 7 * len(asked)
