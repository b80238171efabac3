"""The pipeline against its stages done plainly, document by document and pair by pair."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import decontam, packing, toxicity

pytest.importorskip("corpus_pipeline")

WHITE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(seed):
    """Toxic texts, copies and near copies, repeated lines, edited test items, nulls, empties and one long text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 7)))
    some = lambda n: [word() for _ in range(n)]
    items = [some(r.randint(8, 30)) for _ in range(8)]
    line = "This Footer Line is on many of the pages, and is long."
    rows, labels = [], []
    for i in range(240):
        w = some(r.randint(12, 60))
        if i % 4 == 0:
            w.insert(r.randrange(len(w)), r.choice(["zzvile", "zzfoulest", "qqnasty"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    base = some(80)
    for i in range(300, 312):
        w = list(base)
        w[r.randrange(len(w))] = word()  # equal lines in five documents would be gone before the join
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(base[:40])) for i in range(330, 336)]
    rows += [(i, " ".join(some(20)) + f"\n  {line.upper() if i % 2 else line}\t\n" + " ".join(some(9))) for i in range(320, 329)]
    for i, item in enumerate(items):
        edited = [word() if r.random() < 0.1 else x for x in item]
        rows.append((340 + i, " ".join(some(30) + edited + some(25))))
    rows += [(400, None), (401, ""), (402, "one two"), (403, "one two"), (404, " ".join(some(6000))), (405, "\n\n")]
    return rows, labels, [(i, " ".join(x)) for i, x in enumerate(items)]


def plain_toxic(model, text):
    hit = {f for f in toxicity.features(text or "") if f in model.weights}
    z = model.bias + sum(model.weights[f] for f in hit)
    return 1 / (1 + math.exp(-z)) if z > -30 else 0.0


def plain_lines(rows):
    key = lambda x: x.strip(WHITE).translate(LOW)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    return [(i, "\n".join(x for x in (t or "").split("\n") if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == i)) for i, t in rows]


def plain_groups(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").translate(LOW).split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in links:
            up[i] = up[j] = min(up[i], up[j])
    return [(i, t) for i, t in rows if up[i] == i]


def plain_share(item, words):
    best, row = 0, [0] * (len(words) + 1)
    for a in item:
        new = [0]
        for j, b in enumerate(words, 1):
            new.append(max(0, row[j - 1] + (2 if a == b else -1), row[j] - 1, new[-1] - 1))
            best = max(best, new[-1])
        row = new
    return best / (2 * len(item))


def test_run_against_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rows, labels, items = rows_of(11)
    docs = spark.createDataFrame([(i, t, "en", "s%d" % (i % 3), len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame([(i, 1, x) for i, x in labels], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())

    model = toxicity.train(docs, lab)
    left = [(i, t) for i, t in rows if plain_toxic(model, t) < 0.5]
    assert len(left) < len(rows) - 40
    left = plain_lines(left)
    n = len(left)
    left = plain_groups(left)
    assert len(left) <= n - 11
    n = len(left)
    tests = [decontam.words_of(t) for _, t in items]
    left = [(i, t) for i, t in left if not any(plain_share(x, decontam.words_of(t)) >= 0.6 for x in tests)]
    assert len(left) <= n - 6
    tok, want = Tokenizer.from_file(packing.tokenizer_path()), []
    for i, t in left:
        ids, at = [*tok.encode(t, add_special_tokens=False).ids, 0], 0
        for k in packing.piece_lengths(len(ids), 1024):
            want.append((i, at, k, zlib.crc32(np.array(ids[at : at + k], "<u4").tobytes()), len(ids)))
            at += k
    assert got == sorted(want)


def test_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert 0.7 * n <= len(rows) <= docs.count()
        docs = spark.createDataFrame(rows, docs.schema)


def test_stages_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    rows, labels, items = rows_of(2)
    spark.createDataFrame([(i, 1, x) for i, x in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
