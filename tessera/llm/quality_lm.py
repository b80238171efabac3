"""Text quality by an interpolated modified Kneser-Ney n-gram model of trusted text.

The order is a parameter; the query takes three.
Words are runs of non-space bytes, hashed to 64 bits; begin and end marks count as
words. Trusted rows are split in two by a hash of doc_id: one part trains, the
other gives each language's quantile of perplexity, so thresholds come from text
the model has not seen. Counts come from the training half alone, about half of
the trusted text; all of that half is counted and all documents are scored.

An n-gram lives in the shard of its own hash, so a frequent word does not crowd a
shard. A block of text deals each of its distinct n-grams once. Counts of order
``order`` come first; each shard then tells the shards of the suffixes how many
distinct n-grams end in them (n-grams at a text's begin keep their counts), and the
shards of the contexts how often which counts follow them. The model is these numbers,
for each n-gram its count and its sums as a context.

No probability is stored: the contexts and suffixes of a document's n-grams are n-grams
of the document, so who has the numbers of all of them can work it out. Documents ask for
numbers, a block for its distinct n-grams once, and a block's answers meet again with
its words. This runs in ``batches`` parts, whose tables and shuffle files go when they
are scored; the model is bucketed by shard, so no part shuffles it.

What is written and sent is packed (``_arrays``): words of n-grams as places in a list of
the distinct ones, sorted hashes as gaps, numbers by their bytes, all under zstd.

Thresholds are quantiles over bins of log perplexity, ``BIN`` wide: sums that do not
depend on the order of merging, at most ``BIN`` (relative) above the exact quantile.

Defined results: null and empty texts have a null perplexity and aren't kept; a
perplexity equal to the threshold is kept; rows that share a doc_id are scored each;
languages (null is one) without unseen trusted text take the threshold of all;
without any trusted text nothing can be said and perplexity, threshold are null and
keep is false; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import MULT, Workspace, gram_hashes, hash_words, mix, shuffle_partitions, sorted_runs, texts_of

BEGIN, END = np.uint64(1), np.uint64(2)
POSITIONS = 600_000  # words that a task deals at once
PER_SHARD = 1_200_000
BIN = 1e-3
NAMES = ["shard", "kind", "origin", "blob"]
SHARDED = "shard int, kind int, origin int, blob binary"
GRAMS, STATS, CONTEXTS, MODEL = range(2, 6)
_KINDS = ["u1", "u2", "u4", "u8", "i4", "i8", "f8"]
PLAIN, GAPS, PLACES = range(3)  # how an array is packed


def words_of(text: bytes) -> np.ndarray:
    """The words of a text between its marks."""
    w = hash_words(text)
    return np.concatenate([[BEGIN], np.where(w < 3, np.uint64(3), w), [END]])


def _arrays(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, packed: rows of hashes as places in the sorted distinct ones, ascending hashes as gaps, all by bytes of one weight."""
    head, planes = [len(arrays)], []

    def add(a: np.ndarray) -> None:
        head.extend([_KINDS.index(a.dtype.str[1:]), len(a)])
        planes.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())

    for a in arrays:
        if a.ndim == 2:
            word, at = np.unique(a, return_inverse=True)
            head.extend([PLACES, a.shape[1], 0])
            add(np.diff(word, prepend=np.uint64(0)))
            add(at.reshape(-1, a.shape[1]).T.ravel().astype(np.uint16 if len(word) <= 1 << 16 else np.uint32))
        elif a.dtype == np.uint64 and len(a) and (a[1:] >= a[:-1]).all():
            gaps = np.diff(a)
            step = int(np.gcd.reduce(gaps)) or 1 if len(gaps) else 1  # hashes of one shard leave the same remainder
            head.extend([GAPS, int(a[:1].view(np.int64).sum()), np.uint64(step).view(np.int64).item()])
            add(gaps // np.uint64(step))
        else:
            head.extend([PLAIN, 0, 0])
            add(a)
    body = np.array([len(head), *head], np.int64).tobytes() + b"".join(planes)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _of(blob: bytes) -> list[np.ndarray]:
    body = pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    many = int(np.frombuffer(body, np.int64, 1)[0])
    head, at, out = iter(np.frombuffer(body, np.int64, many, 8).tolist()), 8 + 8 * many, []

    def take() -> np.ndarray:
        nonlocal at
        kind, n = np.dtype(_KINDS[next(head)]), next(head)
        planes = np.frombuffer(body, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        at += n * kind.itemsize
        return np.ascontiguousarray(planes.T).reshape(-1).view(kind)

    for _ in range(next(head)):
        how, x, step = next(head), next(head), next(head)
        a = take()
        if how == GAPS:
            a = np.cumsum(np.r_[np.int64(x).view(np.uint64), a * np.int64(step).view(np.uint64)], dtype=np.uint64)
        out.append(np.cumsum(a, dtype=np.uint64)[take().reshape(x, -1).T] if how == PLACES else a)
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary())], NAMES)


def _hash(records: np.ndarray) -> np.ndarray:
    """Hashes of n-grams given as rows of word hashes, as ``gram_hashes`` gives them."""
    h = np.zeros(len(records), np.uint64)
    for k in range(records.shape[1]):
        h = h * MULT + records[:, k]
    return mix(h)


def _to_shards(kind: int, origin: int, names: np.ndarray, shards: int, *arrays: np.ndarray) -> list[tuple]:
    """Rows that take arrays, entry by entry, to the shards of their hashes."""
    shard = (names % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cut = [0, *(np.flatnonzero(np.diff(shard[order])) + 1), len(order)]
    return [(int(shard[order[a]]), kind, origin, _arrays(*(x[order[a:z]] for x in arrays))) for a, z in zip(cut, cut[1:]) if a < z]


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for b in batches:
        f = b.schema.get_field_index
        for kind, origin, x in zip(b.column(f("kind")).to_pylist(), b.column(f("origin")).to_pylist(), b.column(f("blob"))):
            yield kind, origin, _of(x.as_buffer().to_pybytes())


def _add_up(records: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes, records and sums of each of the numbers of the distinct records; those that begin alike stand together, which packs best."""
    name, first, inv = np.unique(_hash(records), return_index=True, return_inverse=True)
    first, high = first.astype(np.int64), np.uint64(32)
    order = np.argsort((records[first, 0] >> high << high) | (records[first, 1 % records.shape[1]] >> high))
    return name[order], records[first[order]], *(np.bincount(inv, weights=x, minlength=len(name)).astype(np.int64)[order] for x in numbers)


def _windows(w: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(w, n) if len(w) >= n else np.empty((0, n), np.uint64)


def _small(numbers: np.ndarray) -> np.ndarray:
    """Numbers in four bytes if they fit."""
    return numbers.astype(np.uint32) if not len(numbers) or numbers.max() < 1 << 32 else numbers


def _deal(docs: DataFrame, n: int, shards: int, whole: bool) -> DataFrame:
    """Distinct n-grams of a block with counts: all, or those at a text's begin."""
    order = n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            own = np.concatenate([_windows(w, order) for w in held])
            if not len(own):
                return _rows([])
            name, record, many = _add_up(own, np.ones(len(own)))
            return _rows(_to_shards(GRAMS, order, name, shards, record, _small(many)))

        for b in batches:
            for t in texts_of(b):
                if t.strip():
                    held.append(words_of(t if whole else b" ".join(t.split(None, order)[:order]))[: None if whole else order])
                    n += len(held[-1])
                    if n >= POSITIONS:
                        yield flush()
                        held, n = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, SHARDED)


def _tell(counts: DataFrame, n: int, shards: int) -> DataFrame:
    """What a shard of n-grams tells the shards of their suffixes and contexts.

    Of a suffix, how many of the shard's n-grams end in it; of a context, the sum of
    their counts and how many counts are 1, 2 and more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(3):
                record, many = _of(blob.as_buffer().to_pybytes())[:2]
                suffix, rest, times = _add_up(record[many > 0, 1:], np.ones(int((many > 0).sum())))
                yield _rows(_to_shards(GRAMS, n - 1, suffix, shards, rest, _small(times)))
                record, many = record[many > 0], many[many > 0]
                context, inv = np.unique(_hash(record[:, :-1]), return_inverse=True)
                sums = [np.bincount(inv, weights=x, minlength=len(context)).astype(np.int64) for x in (many, many == 1, many == 2, many > 2)]
                yield _rows(_to_shards(CONTEXTS, n - 1, context, shards, context, *map(_small, sums)))

    return counts.where(f"kind = {GRAMS}").select(*NAMES).mapInArrow(run, SHARDED)


def _count(dealt: DataFrame, n: int) -> DataFrame:
    """A shard's n-grams with their counts and, as contexts, four sums (0 for none); counts of counts.

    Every context is among the n-grams, but for the mark of a text's begin: it gets a count of 0.
    """

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, told = [], []
        for kind, _, x in _blobs(batches):
            (told if kind == CONTEXTS else own).append(x)
        names = np.concatenate([x[0] for x in told]) if told else np.empty(0, np.uint64)
        begin = np.full((1, 1), BEGIN)
        if n == 1 and (names == _hash(begin)).any():
            own.append([begin, np.zeros(1, np.int64)])
        name, record, many = _add_up(*(np.concatenate([x[k] for x in own]) for k in (0, 1)))
        by = np.argsort(name)
        at = by[np.searchsorted(name, names, sorter=by)]
        sums = [np.bincount(at, weights=np.concatenate([x[k] for x in told]) if told else None, minlength=len(name)).astype(np.int64) for k in range(1, 5)]
        me = key[0].as_py()
        stats = np.array([*(int((many == k).sum()) for k in (1, 2, 3, 4)), int((many > 0).sum()), int(many.sum())], np.int64)
        yield _rows([(me, GRAMS, n, _arrays(record, _small(many), *map(_small, sums))), (me, STATS, n, _arrays(stats))])

    return dealt.groupBy("shard").applyInArrow(run, SHARDED)


def discounts(c: np.ndarray) -> np.ndarray:
    """Discounts for counts of 1, 2 and more, from the counts of counts."""
    n1, n2, n3, n4 = (max(float(x), 0.5) for x in c[:4])
    y = n1 / (n1 + 2 * n2)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0.1, 0.2, 0.3], [0.95, 1.9, 2.9])


def _stats(counts: DataFrame) -> np.ndarray:
    """Six numbers of a shard each, added up."""
    return sum((_of(bytes(r.blob))[0] for r in counts.where(f"kind = {STATS}").select("blob").collect()), np.zeros(6, np.int64))


def _numbers(counts: DataFrame, lower: DataFrame) -> DataFrame:
    """Per shard, sorted hashes of n-grams with their five numbers: those of one order, and of all lower ones. Neither is moved."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, numbers, me = [], [], None
        for t in (left, right):
            for me, kind, blob in zip(*(t.column(c).to_pylist() for c in ("shard", "kind", "blob"))):
                name, *x = _of(blob)
                names.append(name if kind == MODEL else _hash(name)), numbers.append(np.stack(x, 1).astype(np.int64))
        name, number = np.concatenate(names), np.concatenate(numbers)
        order = np.argsort(name)
        return pa.Table.from_batches([_rows([(me, MODEL, 0, _arrays(name[order], *(_small(x) for x in number[order].T)))])])

    return counts.where(f"kind = {GRAMS}").groupBy("shard").cogroup(lower.where(f"kind <> {STATS}").groupBy("shard")).applyInArrow(run, SHARDED)


def train(ws: Workspace, docs: DataFrame, order: int, shards: int) -> tuple[DataFrame, dict[int, np.ndarray]] | None:
    """(numbers per shard, counts of counts by order), None without any text."""
    counts: dict[int, DataFrame] = {}
    c: dict[int, np.ndarray] = {}
    docs = ws.write(docs.select("text"), "texts", clean=True)  # so that the shuffle that finds them does not last
    with sorted_runs(ws.spark):
        begins = {n: ws.write(_deal(docs, n, shards, False), f"begins{n}") for n in range(order - 1, 1, -1)}
        for n in range(order, 0, -1):
            rows = _deal(docs, n, shards, True) if n == order else _tell(counts[n + 1], n + 1, shards)
            if n in begins:
                rows = rows.unionByName(begins[n])
            counts[n] = ws.write_sorted(_count(rows, n), f"counts{n}", ["shard"], clean=True)  # bucketed, so that it is not shuffled again
            c[n] = _stats(counts[n])
            if n > 1:
                ws.drop(docs if n == order else begins[n])
        if not c[1][5]:
            return None
        model = counts[1]
        for n in range(2, order + 1):
            lower, model = model, ws.write_sorted(_numbers(counts[n], model), f"numbers{n}", ["shard"], clean=True)
            ws.drop(counts[n], lower)
        ws.drop_but(model)
    return model, c


def _all_grams(word: np.ndarray, at: np.ndarray, lens: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order, the hashes of n-grams, and the place of each n-gram's hash and where it begins, in sequences laid end to end.

    ``word`` are the distinct words and ``at`` their places in the sequences.
    """
    doc = np.repeat(np.arange(len(lens)), lens)
    out = [(gram_hashes(word, 1), at, np.arange(len(at)))]
    flat = word[at]
    for n in range(2, order + 1):
        h = gram_hashes(flat, n)
        same = doc[: len(h)] == doc[n - 1 : n - 1 + len(h)]
        name, inv = np.unique(h[same], return_inverse=True)
        out.append((name, inv, np.flatnonzero(same)))
    return out


ASKED = "shard int, base long, blob binary, doc_id array<long>, lang array<string>, unseen array<boolean>"
_LISTS = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.bool_())]


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), *_LISTS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in ASKED.split(", ")])


def _ask(docs: DataFrame, order: int, shards: int) -> DataFrame:
    """shard >= 0: the distinct n-grams of a block that belong there. shard null: the block's rows and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33  # rows are numbered by place in the task's input, so a retry gives the same numbers
        meta, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            lens = np.array([len(x) for x in held], np.int32)
            word, at = np.unique(np.concatenate(held), return_inverse=True)
            rows = [(None, base, _arrays(word, at.astype(np.uint16 if len(word) <= 1 << 16 else np.uint32), lens), *map(list, zip(*meta)))]
            for n, (name, _, _) in enumerate(_all_grams(word, at, lens, order)):
                rows += [(s, base, _arrays(np.array([n]), *_of(blob)), None, None, None) for s, _, _, blob in _to_shards(0, 0, name, shards, name)]
            return _asked(rows)

        for b in batches:
            for doc_id, lang, unseen, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts_of(b)):
                held.append(words_of(t) if t.strip() else np.empty(0, np.uint64))
                meta.append((doc_id, lang, unseen))
                size += len(held[-1])
                if size >= POSITIONS or len(held) >= 100_000:
                    yield flush()
                    base += len(held)
                    meta, held, size = [], [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "lang", "unseen", "text").mapInArrow(run, ASKED)


def _answer(asked: DataFrame, model: DataFrame) -> DataFrame:
    """Per block, from every shard that it asked, the places of the n-grams known there and their numbers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(right):
            name, *numbers = _of(right.column("blob")[0].as_py())
            for shard, base, blob in zip(*(left.column(c).to_pylist() for c in ("shard", "base", "blob"))):
                n, own = _of(blob)
                i = np.minimum(np.searchsorted(name, own), len(name) - 1)
                at = np.flatnonzero(name[i] == own)
                gaps = np.diff(at, prepend=0).astype(np.uint32)
                out.append((shard, base, _arrays(n, gaps, *(_small(x[i[at]]) for x in numbers)), None, None, None))
        empty = pa.schema(list(zip([x.split()[0] for x in ASKED.split(", ")], [pa.int32(), pa.int64(), pa.binary(), *_LISTS])))
        return pa.Table.from_batches([_asked(out)]) if out else empty.empty_table()

    return asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(run, ASKED)


def _collect(rows: DataFrame, order: int, shards: int, c: dict[int, np.ndarray]) -> DataFrame:
    """doc_id, lang, unseen, n_words, s: the log probability of every row of a block."""
    cut = {n: discounts(c[n]) for n in c}
    ones, every, words = c[1][:2], int(c[1][5]), int(c[1][4])
    spare = float(np.dot(cut[1], [*ones, words - ones.sum()])) / every / (words + 1)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meta, words, parts = None, None, []
        for b in batches:
            f = b.schema.get_field_index
            for shard, blob, *row in zip(*(b.column(f(c)).to_pylist() for c in ("shard", "blob", "doc_id", "lang", "unseen"))):
                if shard is None:
                    meta, words = row, _of(blob)
                else:
                    parts.append((shard, *_of(blob)))
        word, at, lens = words
        at, lens = at.astype(np.int64), lens.astype(np.int64)
        log, doc = np.zeros(len(lens)), np.repeat(np.arange(len(lens)), lens)
        opens = np.diff(doc, prepend=-1) > 0
        p = total = spread = None  # by where an (n - 1)-gram begins: its probability; as a context, its sum of counts and what is left for lower orders
        for n, (name, place, begins) in enumerate(_all_grams(word, at, lens, order), 1):
            many, sums, left = (np.zeros(len(name)) for _ in range(3))
            home = (name % np.uint64(shards)).astype(np.int64)
            by = np.argsort(home, kind="stable")
            start = np.searchsorted(home[by], np.arange(shards))
            for shard, own, gaps, *x in parts:
                if own[0] == n - 1:
                    i = by[start[shard] + np.cumsum(gaps, dtype=np.int64)]
                    many[i] = x[0]
                    if n < order:
                        sums[i], left[i] = x[1], sum(d * y for d, y in zip(cut[n + 1], x[2:]))
            q = np.where(many > 0, np.maximum(many - cut[n][np.clip(many, 1, 3).astype(np.int64) - 1], 0), 0)[place]
            if n == 1:
                q = q / every + spare
            else:
                below = p[begins + 1]
                q = np.where(total[begins] > 0, (q + spread[begins] * below) / np.maximum(total[begins], 1), below)
                ends = slice(None) if n == order else opens[begins]  # shorter n-grams count at a text's begin only
                log += np.bincount(doc[begins[ends]], weights=np.log(q[ends]), minlength=len(lens))
            if n < order:
                p, total, spread = (np.zeros(len(at) + 1) for _ in range(3))
                p[begins], total[begins], spread[begins] = q, sums[place], left[place]
        n_words = np.maximum(lens - 2, 0)
        yield pa.RecordBatch.from_arrays([pa.array(meta[0], pa.int64()), pa.array(meta[1], pa.string()), pa.array(meta[2], pa.bool_()), pa.array(n_words), pa.array(log)], ["doc_id", "lang", "unseen", "n_words", "s"])

    return rows.groupBy("base").applyInArrow(run, "doc_id long, lang string, unseen boolean, n_words long, s double")


def thresholds(known: DataFrame, quantile: float) -> tuple[DataFrame, float | None]:
    """(lang and t, t of all): the upper edge of the bin at which at least the share ``quantile`` of the rows is reached."""
    bins = known.groupBy("lang", F.floor(F.log("perplexity") / BIN).alias("bin")).agg(F.count("*").alias("n"))

    def edge(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys)
        at = rows.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
        first = at.where(F.col("upto") >= F.ceil(F.col("all") * quantile)).groupBy(*keys).agg(F.min("bin").alias("bin"))
        return first.select(*keys, F.exp((F.col("bin") + 1) * BIN).alias("t"))

    whole = edge(bins.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1)), ["one"]).first()
    return edge(bins, ["lang"]), whole and whole.t


def score(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, order: int = 3, batches: int = 10) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, keep of every row of docs."""
    spark = docs.sparkSession
    ws = Workspace(spark, "quality-lm")
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__t")).distinct()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    split = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0
    chars = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-int(chars) // (6 * PER_SHARD)))
    seen = trusted.withColumnRenamed("__t", "doc_id").where(split)
    made = train(Workspace(spark, "quality-model"), d.where(split).join(seen, "doc_id", "left_semi"), order, shards)
    if made is None:
        return d.select("doc_id", "lang", F.lit(0).cast("long").alias("n_words"), *[F.lit(None).cast("double").alias(c) for c in ("perplexity", "threshold")], F.lit(False).alias("keep"))
    model, c = made
    out = None
    for k in range(batches):
        part = d.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(batches)) == k).withColumn("unseen", F.coalesce(~split, F.lit(False)))
        asked = ws.write(_ask(part, order, shards), "asked")
        with sorted_runs(spark):
            answers = _answer(asked.where("shard is not null"), model)
            done = ws.write(_collect(asked.where("shard is null").unionByName(answers), order, shards, c), "scores", clean=True)
        ws.drop(asked)
        out = done if out is None else out.unionByName(done)
    out = out.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-F.col("s") / (F.col("n_words") + 1))))
    known = out.where("unseen and perplexity is not null").join(trusted, F.col("doc_id") == F.col("__t"), "left_semi")
    by, whole = thresholds(known, quantile)
    by = ws.write(by, "thresholds")
    out = out.join(by.withColumnRenamed("lang", "__l"), F.col("lang").eqNullSafe(F.col("__l")), "left").withColumn("threshold", F.coalesce("t", F.lit(whole).cast("double")))
    return out.select("doc_id", "lang", "n_words", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("keep"))
