"""Decontamination against full alignment of every document with every item."""

import random

import numpy as np
import pytest

from tessera.llm import decontam


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, item_id long, share string")


def full(item, words):
    """Plain Smith-Waterman over the whole document: share, first word, word after the last."""
    best, row = (0, 0, 0), [(0, j) for j in range(len(words) + 1)]
    for a in item:
        new = [(0, 0)]
        for j, b in enumerate(words, 1):
            ways = [(row[j - 1][0] + (2 if a == b else -1), row[j - 1][1]), (row[j][0] - 1, row[j][1]), (new[-1][0] - 1, new[-1][1]), (0, j)]
            new.append(max(ways, key=lambda x: x[0]))
            if new[-1][0] > best[0]:
                best = (new[-1][0], new[-1][1], j)
        row = new
    return best[0] / (2 * len(item)), best[1], best[2]


def test_decontamination(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    item = [word() for _ in range(40)]
    edited = [word() if k % 6 == 5 else w for k, w in enumerate(item)]
    some = lambda n: [word() for _ in range(n)]
    rows = [(1, " ".join(some(50) + item + some(50))), (2, " ".join(some(5000) + edited + some(9)).upper()), (3, " ".join(some(30) + item[:8] + some(60))), (4, None), (5, "")]
    bench = spark.createDataFrame([(7, " ".join(item), 1), (8, None, 1), (9, "", 1)], "item_id long, text string, share int")
    got = {(x.doc_id, x.item_id) for x in decontam.report(table(spark, rows), bench).collect()}
    assert got == {(1, 7), (2, 7)}
    assert sorted(x.doc_id for x in decontam.clean(table(spark, rows), bench).collect()) == [3, 4, 5]
    assert decontam.report(table(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_without_spaces(spark):
    """Items inside longer runs of scripts that do not separate words, and beside punctuation beyond ASCII."""
    words = lambda t: [w.decode() for w in decontam.words_of(t)]
    assert words("Das «Haus» – ¿Qué? 2×3 naïve\u00a0“x’s”") == ["das", "haus", "qué", "2", "3", "naïve", "x", "s"]
    assert words("这是，测 ไทย カナ 한국어") == ["这", "是", "测", "ไ", "ท", "ย", "カ", "ナ", "한국어"]
    r = random.Random(3)
    some = lambda a, n: "".join(chr(a + r.randrange(900)) for _ in range(n))
    thai = lambda n: "".join(chr(0x0E01 + r.randrange(46)) for _ in range(n))
    zh, th, es = some(0x4E00, 30) + "，" + some(0x4E00, 20) + "。", thai(60), "qué día tan largo y frío hace hoy"
    rows = [(1, some(0x4E00, 200) + zh + some(0x4E00, 90)), (2, thai(80) + th + thai(50)), (3, some(0x4E00, 300)), (4, "«" + "»—«".join(es.split()) + "»")]
    bench = spark.createDataFrame([(7, zh), (8, th), (9, es)], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.report(table(spark, rows), bench).collect()} == {(1, 7), (2, 8), (4, 9)}


EDITS = ["change", "drop", "insert", "mixed", "second"]


def edited(r, item, how, word):
    out = []
    for k, w in enumerate(item):
        x = r.random()
        if how == "change" and x < 0.2 or how == "mixed" and x < 0.1:
            out.append(word())
        elif how == "drop" and x < 0.2 or how == "mixed" and x < 0.16:
            pass
        elif how == "insert" and x < 0.6 or how == "mixed" and x < 0.3 or how == "second" and k % 2:
            out += [w, word()]
        else:
            out.append(w)
    return out


@pytest.mark.parametrize("how", EDITS)
def test_recall_of_edited_copies(how):
    """Every copy that full alignment gives the least share is found, with the same share; nothing else is."""
    r = random.Random(EDITS.index(how))
    vocabulary = ["w%d" % k for k in range(400)]
    word = lambda: vocabulary[min(399, int(r.expovariate(0.02)))]
    items = [[word() for _ in range(r.randint(6, 60))] for _ in range(24)]
    texts = [[word() for _ in range(30)] + (edited(r, items[k % 24], how, word) if k % 4 else []) + [word() for _ in range(r.randint(0, 40))] for k in range(48)]
    index = decontam.Items([(k, " ".join(x)) for k, x in enumerate(items)], decontam.SEED)
    words = [decontam.hashes_of(" ".join(t)) for t in texts]
    count = np.zeros(len(index.keys), np.int64)
    for w in words:
        count[np.unique(index.hits(w)[1])] += 1
    index.keep(dict(zip(index.keys.view(np.int64).tolist(), count.tolist())))
    wanted = found = exact = 0
    for t, w in zip(texts, words):
        got = {x[0]: x[1:] for x in decontam.leaks(index, w, 0.6)}
        for k, item in enumerate(items):
            share, first, last = full(item, t)
            if share >= 0.6:
                wanted += 1
                found += k in got
                exact += k in got and abs(got[k][0] - share) < 1e-12
                if k in got and t[first:last] == item:
                    assert got[k][1:] == (first, last)
            else:
                assert k not in got
    assert wanted >= 15 and found == exact == wanted, (wanted, found, exact)


def test_places_are_traced(spark):
    r = random.Random(7)
    some = lambda n: ["x%d" % r.randrange(10**6) for _ in range(n)]
    item = some(30)
    short = item[:12] + item[20:]  # eight words are missing
    rows = [(1, " ".join(some(20) + short + some(9))), (2, " ".join(some(5) + item + some(40) + item))]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {x.doc_id: (round(x.share, 3), x.start, x.end) for x in decontam.report(table(spark, rows), bench).collect()}
    assert got == {1: (round((2 * 22 - 8) / 60, 3), 20, 42), 2: (1.0, 5, 35)}  # the first of two equal places


def test_blocks_of_items_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    r = random.Random(8)
    some = lambda n: ["x%d" % r.randrange(10**6) for _ in range(n)]
    items = [some(20) for _ in range(9)]
    rows = [(1, " ".join(some(100_000) + items[3] + items[3] + some(10))), (2, " ".join(items[5] * 2000)), (2, " ".join(items[5] * 2000)), (3, "a " * 200_000), (None, " ".join(items[0]))]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(8, " ".join(items[8]))], "item_id long, text string")
    got = sorted((x.doc_id or 0, x.item_id, x.share) for x in decontam.report(table(spark, rows), bench).collect())
    assert got == [(0, 0, 1.0), (1, 3, 1.0), (2, 5, 1.0), (2, 5, 1.0)]
    assert [x.doc_id for x in decontam.clean(table(spark, rows), bench).collect()] == [3]
    assert decontam.report(table(spark, []), bench).count() == 0
