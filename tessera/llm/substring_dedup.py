"""Substring dedup with a compressed FM-index per shard.

A window is ``width`` consecutive words. Its seed is the least hash of its
``SEEDS[0]``-word grams, so equal windows have equal seeds, wherever they stand;
runs of windows with one seed are segments.

1. One pass gives the seeds; those of a single document cannot be repeated.
2. A second pass cuts out the segments of shared seeds (a fixed-size filter picks
   them). Equal segments are one content with the least doc_id that holds it, so
   copies never pile up.
3. Contents are dealt to shards by seed. Each shard builds an FM-index of its
   contents and streams them through it: backward search over the wavelet matrix
   gives, at a place, how far to the left the words also occur in a smaller
   document; matches of at least ``width`` words are reported as runs of windows.
   A seed whose contents are more than ``WORDS_PER_SHARD`` words goes down a level:
   its contents are the documents of a search with longer grams (``SEEDS``), so an
   index is bounded by words. At the last level the gram is the window itself.
4. Runs go back to the documents that hold the content; a document that isn't a
   content's first loses all its windows. Contents that very many documents hold
   (``HOT``, or a 100,000th of all segments, so at most 100,000) go by a broadcast.

Defined results: null or short texts keep all words; rows that share a doc_id
are one document (not smaller than itself); null ids are one document below all
others; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import MULT, Workspace, gram_hashes, hash_words, id_key, mix, shuffle_partitions, text_key, texts_of
from tessera.llm.fm_index import FMIndex

SEEDS = (8, 24, 40)  # words in the grams of each level; those of the last are windows
LONGEST = 512  # windows in one segment
WORDS_PER_SHARD = 400_000
HOT, HOT_KEYS = 100_000, 100_000
FILTER_BITS = (20, 30)  # log2 of the filter's size, by the number of shared seeds: at most 128 MB


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive values."""
    n = len(x)
    rows = -(-n // k)
    pad = np.full(rows * k, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    block = pad.reshape(rows, k)
    fwd = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - k + 1], fwd[k - 1 : n])


def segments(words: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, first window, number of windows) of the segments of a sequence of word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    m = sliding_min(gram_hashes(words, gram), width - gram + 1)
    cut = np.flatnonzero(m[1:] != m[:-1]) + 1
    start = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([start, [n]]))
    if size.max() > LONGEST:
        many = -(-size // LONGEST)
        base = np.repeat(start, many)
        k = np.arange(len(base)) - np.repeat(np.cumsum(many) - many, many)
        end = np.repeat(start + size, many)
        start = base + k * LONGEST
        size = np.minimum(end - start, LONGEST)
    return m[start], start, size


def content_hash(words: np.ndarray) -> bytes:
    """128 bits."""
    w = words.view(np.uint64)
    k = np.arange(1, len(w) + 1, dtype=np.uint64)
    x = mix(w + k * MULT)
    return mix(np.array([x.sum() + np.uint64(len(w)), (mix(x ^ MULT) * (k | np.uint64(1))).sum()], np.uint64)).tobytes()


def _words(body: bytes, level: int) -> np.ndarray:
    """Word hashes of a row: of its text, or (below the first level) as they are given."""
    return np.frombuffer(body, np.uint64) if level else hash_words(body)


def _gram(level: int, width: int) -> int:
    return min(SEEDS[level], width) if level < len(SEEDS) else width


def _seeds(rows: DataFrame, width: int, level: int) -> DataFrame:
    """seed, doc: the distinct seeds of each row."""
    gram = _gram(level, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, ids = [], []
            for d, t in zip(b.column(0).to_pylist(), texts_of(b, "body")):
                s = np.unique(segments(_words(t, level), width, gram)[0])
                got.append(s)
                ids.append(np.full(len(s), d, np.int64))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64)), pa.array(np.concatenate(ids))], ["seed", "doc"])

    return rows.select("doc", "body").mapInArrow(run, "seed long, doc long")


def _bit(seed: np.ndarray, bits: int) -> np.ndarray:
    return (mix(seed.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _filter(shared: DataFrame, bits: int) -> bytes:
    """A bit table of the shared seeds, built in parts of 2**15 bits."""

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 12, np.uint8)
        for b in batches:
            at = b.column(b.schema.get_field_index("at")).to_numpy(zero_copy_only=False)
            np.bitwise_or.at(total, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_bit(b.column(0).to_numpy(zero_copy_only=False), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 15).astype(np.int32)), pa.array((at & 0x7FFF).astype(np.int32))], ["chunk", "at"])

    parts = shared.select("seed").mapInArrow(mark, "chunk int, at int").groupBy("chunk").applyInArrow(join, "chunk int, bits binary")
    got = {r["chunk"]: bytes(r["bits"]) for r in parts.collect()}
    return b"".join(got.get(i, b"\0" * 4096) for i in range(1 << (bits - 15)))


def _cut(rows: DataFrame, width: int, level: int, table: bytes, bits: int) -> DataFrame:
    """kind 0: a row's segment (doc, tk, start, size, ch). kind 1: a content, once a task (ch, seed, doc = least so far, words)."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    schema = "kind int, ch binary, doc long, tk long, start int, size int, seed long, words binary"
    names = ["kind", "ch", "doc", "tk", "start", "size", "seed", "words"]
    gram = _gram(level, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(shared.value, np.uint8)
        seen: dict[bytes, int] = {}
        for b in batches:
            out: list[tuple] = []
            for doc, tk, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b, "body")):
                w = _words(t, level)
                seed, start, size = segments(w, width, gram)
                if not len(seed):
                    continue
                at = _bit(seed, bits)
                for j in np.flatnonzero((mask[at >> 3] >> (at & 7)) & 1):
                    s, k = int(start[j]), int(size[j])
                    words = w[s : s + k + width - 1]
                    ch = content_hash(words)
                    out.append((0, ch, doc, tk, s, k, None, None))
                    if ch not in seen or doc < seen[ch]:
                        out.append((1, ch, doc, None, None, k, int(seed[j].view(np.int64)), None if ch in seen else words.tobytes()))
                        if len(seen) > 500_000:
                            seen.clear()
                        seen[ch] = doc
                if len(out) > 20_000:
                    yield _table(out, names)
                    out = []
            if out:
                yield _table(out, names)

    return rows.select("doc", "tk", "body").mapInArrow(run, schema)


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _search(contents: DataFrame, width: int) -> DataFrame:
    """ch, runs: first and last window (int32 pairs) of the runs that a content of a smaller document holds too."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ch, low, seed, words = [], [], [], []
        for b in batches:
            f = b.schema.get_field_index
            ch += b.column(f("ch")).to_pylist()
            low += b.column(f("low")).to_pylist()
            seed += b.column(f("seed")).to_pylist()
            words += [np.frombuffer(x.as_buffer().to_pybytes(), np.int64) for x in b.column(f("words"))]
        low, seed = np.array(low, np.int64), np.array(seed, np.int64)
        _, inv, many = np.unique(seed, return_inverse=True, return_counts=True)
        use = np.flatnonzero(many[inv] > 1)
        if not len(use):
            return
        use = use[np.argsort(low[use], kind="stable")]
        values = np.unique(low[use], return_inverse=True)[1].astype(np.int32)
        index = FMIndex([words[i] for i in use], values)
        ask = np.flatnonzero(values > 0)
        count = np.array([len(words[use[i]]) - width + 1 for i in ask], np.int64)
        found: dict[int, list[int]] = {}
        for i, a, z in index.windows(ask, count, values[ask], width):
            found.setdefault(i, []).extend((a, z))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([ch[use[ask[i]]] for i in found], pa.binary()), pa.array([np.array(v, np.int32).tobytes() for v in found.values()], pa.binary())], ["ch", "runs"])

    return contents.groupBy("shard").applyInArrow(run, "ch binary, runs binary")


def _repeated(ws: Workspace, rows: DataFrame, width: int, level: int) -> DataFrame:
    """doc, tk, runs: first and last windows (int32 pairs) of the rows (doc, tk, body) that rows of a smaller doc hold too."""
    spark = ws.spark
    shared = ws.write(_seeds(rows, width, level).groupBy("seed").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("seed"), "seeds")
    n = shared.count()
    bits = min(max(FILTER_BITS[0], int(16 * max(n, 1)).bit_length()), FILTER_BITS[1])
    cut = ws.write(_cut(rows, width, level, _filter(shared, bits), bits), "segments")
    ws.drop(shared)
    contents = cut.where("kind = 1").groupBy("ch").agg(F.min("doc").alias("low"), F.first("seed").alias("seed"), F.max("size").alias("size"), F.first("words", ignorenulls=True).alias("words"))
    contents = ws.write(contents.withColumn("cid", F.monotonically_increasing_id()), "contents")  # written once, so the numbers stay
    cost = F.sum(F.col("size") + width)
    total = contents.agg(cost).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-int(total) // WORDS_PER_SHARD))
    below, usual = None, contents
    if level < len(SEEDS):
        crowded = ws.write(contents.groupBy("seed").agg(cost.alias("n")).where(F.col("n") > WORDS_PER_SHARD).select("seed"), "crowded")
        if not crowded.isEmpty():
            below = ws.write(contents.join(crowded, "seed", "left_semi").select(F.col("low").alias("doc"), F.col("cid").alias("tk"), F.col("words").alias("body"), "ch"), "below")
            usual = contents.join(crowded, "seed", "left_anti")
    dealt = usual.select("ch", "low", "seed", "words", F.pmod(F.xxhash64("seed"), F.lit(shards)).alias("shard"))
    found = _search(dealt, width)
    if below is not None:
        deeper = _repeated(ws, below, width, level + 1).groupBy("tk").agg(F.unhex(F.array_join(F.collect_list(F.hex("runs")), "")).alias("runs"))
        found = found.unionByName(below.select("tk", "ch").join(deeper, "tk").select("ch", "runs"))
    found = ws.write(found, "runs")
    whole = contents.select("ch", "low").join(found, "ch", "left")
    own = cut.where("kind = 0").select("ch", "doc", "tk", "start", "size")
    held = own.groupBy("ch").agg(F.count("*").alias("n"))
    most = max(HOT, own.count() // HOT_KEYS)
    hot = whole.join(held.where(F.col("n") > most).select("ch"), "ch", "left_semi").select("ch", F.col("low").alias("hot_low"), F.col("runs").alias("hot_runs"))
    own = own.join(F.broadcast(hot), "ch", "left")  # at most 100,000 rows
    rare = whole.where("low is not null").select(F.col("ch").alias("c"), "low", "runs")
    # Segments of hot contents know their answer already; a key of their own spreads them.
    own = own.withColumn("c", F.when(F.col("hot_low").isNull(), F.col("ch")).otherwise(F.md5(F.concat("ch", F.col("doc").cast("string"), F.col("start").cast("string"))).cast("binary")))
    hit = own.join(rare, "c", "left").select("doc", "tk", "start", "size", F.coalesce("hot_low", "low").alias("low"), F.coalesce("hot_runs", "runs").alias("runs"))
    hit = hit.where("doc > low or runs is not null").select("doc", "tk", "start", "size", F.when(F.col("doc") <= F.col("low"), F.col("runs")).alias("runs"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for start, size, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                a = np.array([[0, size - 1]], np.int32) if r is None else np.frombuffer(r, np.int32).reshape(-1, 2).copy()
                out.append((a + start).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc", "tk", "runs"])

    out = ws.write(hit.mapInArrow(place, "doc long, tk long, runs binary"), f"spans{level}")
    ws.drop(cut, contents, found)
    return out


def spans(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc, tk, runs: for each row with repeated windows, first and last windows (int32 pairs) to remove."""
    ws = Workspace(docs.sparkSession, "substring-dedup")
    rows = docs.select(id_key().alias("doc"), text_key().alias("tk"), F.col("text").cast("binary").alias("body"))
    found = _repeated(ws, rows, width, 0)
    out = ws.write(found.groupBy("doc", "tk").agg(F.collect_set("runs").alias("runs")), "spans")
    ws.drop_but(out)
    return out


def keep_mask(n: int, runs: list[bytes] | None, width: int) -> np.ndarray:
    """Which of n words no window of the runs covers."""
    edge = np.zeros(n + 1, np.int64)
    for r in runs or ():
        a = np.frombuffer(r, np.int32).reshape(-1, 2)
        np.add.at(edge, a[:, 0], 1)
        np.add.at(edge, a[:, 1] + width, -1)
    return np.cumsum(edge[:-1]) == 0


def dedup(docs: DataFrame, width: int = 50, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked, text: each row's kept words joined by a space."""
    s = spans(docs, width)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), id_key().alias("doc"), text_key().alias("tk"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, sha, text = [], [], [], []
            for t, r in zip(texts_of(b), b.column(2).to_pylist()):
                w = t.split()
                if r:
                    keep = keep_mask(len(w), r, width)
                    kept = [x for x, k in zip(w, keep.tolist()) if k]
                else:
                    kept = w
                joined = b" ".join(kept)
                n_words.append(len(w))
                n_removed.append(len(w) - len(kept))
                sha.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    text.append(joined.decode("utf-8", "replace"))
            cols = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(text, pa.string())] if with_text else []), names)

    return d.join(s, ["doc", "tk"], "left").select("doc_id", "text", "runs").mapInArrow(run, schema)
