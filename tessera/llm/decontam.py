"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Test items are taken in blocks of about ``BLOCK_BYTES`` of text (each block is
   sent to the executors; more items mean more passes, not a larger broadcast). A
   first pass counts in how many documents each of their word pairs occurs; an
   item's seeds are its pairs but for the commonest tenth.
2. A second pass finds seeds in every whole text. An edited copy that aligns with
   the share ``least`` of the full score holds at least (2 * least - 1) * m - 1 of
   the item's m - 1 pairs, within (3 - 2 * least) * m words: an inserted word costs
   one point and one pair, a changed or missing one three points and two pairs. So
   stretches with that many seeds (less those left out), which also hold the share
   ``least`` of the item's words, are aligned with the item by Smith-Waterman over
   words (match 2, mismatch -1, gap -1), and none is missed.
3. The best alignment's share of the item's full score is reported, with the places
   of its first word and after its last (the first such place, on ties); a share of at
   least ``least`` marks the document.

Words are lower-cased runs of letters, digits and marks; punctuation, symbols and
spaces of Unicode end them. In scripts that do not separate words (Chinese,
Japanese, Thai and others) each character is a word. Defined results: null or empty
texts and items never match; items of one word are seeds
themselves; rows that share an id are judged each; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, gram_hashes, hash_words, id_key, keyed, mix, text_key

#: ASCII bytes other than letters and digits end a word.
_ENDS_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Characters of scripts that do not separate words: Thai, Lao, Myanmar, Khmer, Tai, Balinese, Javanese, kana, Han.
_ALONE = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u1b00-\u1b7f\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua980-\ua9df\uf900-\ufaff\uff66-\uff9f\U0001aff0-\U0001b16f\U00020000-\U0003ffff])")
BLOCK_BYTES = 6_000_000
SEED = 2
COMMON = 10  # of so many of an item's pairs the commonest is no seed


@cache
def _beyond_ascii() -> tuple[re.Pattern, bytes]:
    """Runs of punctuation, symbols and spaces beyond ASCII, and the zero width space; the bytes of UTF-8 that begin neither these (but for the two signs of the lead of most Latin letters) nor characters that stand alone."""
    every = [(c, chr(c)) for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    alone = {x for _, x in every if _ALONE.match(x)}
    ends = [c for c, x in every if x not in alone and unicodedata.category(x)[0] in "PSZ" or c in (0x85, 0x200B)]
    starts = [c for c, before in zip(ends, [0, *ends]) if c != before + 1]
    stops = [c for c, after in zip(ends, [*ends[1:], 0]) if after != c + 1]
    leads = {x.encode()[0] for x in [*alone, *map(chr, ends)] if x not in _SIGNS}
    return re.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in zip(starts, stops)) + "]+"), bytes(set(range(256)) - leads)


_SIGNS = "\u00d7\u00f7"


def readable(text: str | None) -> bytes:
    """The text in lower case, as bytes in which only ASCII ends words."""
    if not text:
        return b""
    raw = text.lower().encode()
    if not text.isascii():
        ends, plain = _beyond_ascii()
        if raw.translate(None, plain) or any(x in text for x in _SIGNS):  # else only letters beyond ASCII
            raw = _ALONE.sub(r" \1 ", ends.sub(" ", text.lower())).encode()
    return raw


def words_of(text: str | None) -> list[bytes]:
    raw = np.frombuffer(readable(text), np.uint8).copy()
    raw[_ENDS_WORD[raw]] = 32
    return raw.tobytes().split()


def hashes_of(text: str | None) -> np.ndarray:
    """Hashes of the words of a text."""
    return hash_words(readable(text), spaces=_ENDS_WORD)


class Items:
    """One block of test items with their n-grams, as arrays that can be searched."""

    def __init__(self, rows: list[tuple[int, str]], seed: int) -> None:
        self.ids = [r[0] for r in rows]
        self.words = [hashes_of(r[1]) for r in rows]
        self.seed = seed
        gram, item, at = [], [], []
        for k, w in enumerate(self.words):
            g = gram_hashes(w, seed)
            gram.append(g), item.append(np.full(len(g), k)), at.append(np.arange(len(g)))
            if 0 < len(w) < seed:
                g = _short(w)
                gram.append(g), item.append(np.array([k])), at.append(np.array([0]))
        self.gram = np.concatenate(gram) if gram else np.empty(0, np.uint64)
        self.item = np.concatenate(item) if item else np.empty(0, np.int64)
        self.at = np.concatenate(at) if at else np.empty(0, np.int64)
        self.dropped = np.zeros(len(self.words), np.int64)
        self._index()

    def _index(self) -> None:
        self.needs: tuple[float, np.ndarray] | None = None
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.at = self.gram[order], self.item[order], self.at[order]
        self.keys, self.first, self.many = np.unique(self.gram, return_index=True, return_counts=True)
        self.shortest = min((len(w) for w in self.words if len(w)), default=0)
        # A small table of the keys' leading bits: most n-grams of a text need no search.
        self.shift = np.uint64(64 - min(max(16, int(16 * len(self.keys)).bit_length()), 26))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self.keys >> self.shift] = True

    def keep(self, df: dict[int, int]) -> None:
        """Drop the commonest tenth of each item's n-grams."""
        n = np.array([df.get(int(g), 0) for g in self.gram.view(np.int64)], np.int64)
        order = np.lexsort((self.at, -n, self.item))
        size = np.bincount(self.item, minlength=len(self.words))
        place = np.arange(len(order)) - (np.cumsum(size) - size)[self.item[order]]
        gone = np.zeros(len(order), bool)
        gone[order] = place < size[self.item[order]] // COMMON
        self.dropped = np.bincount(self.item[gone], minlength=len(self.words))
        self.gram, self.item, self.at = self.gram[~gone], self.item[~gone], self.at[~gone]
        self._index()

    def need(self, least: float) -> np.ndarray:
        """For each item, how many of its seeds any alignment of share ``least`` holds."""
        if self.needs is None or self.needs[0] != least:
            size = np.array([len(w) for w in self.words], np.int64)
            self.needs = least, np.maximum(1, np.floor((2 * least - 1) * size + 1e-9).astype(np.int64) - 1 - self.dropped)
        return self.needs[1]

    def grams(self, w: np.ndarray) -> np.ndarray:
        return gram_hashes(w, self.seed)

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in w and indices into keys of the n-grams that are some item's."""
        g = self.grams(w)
        place = np.arange(len(g))
        if self.shortest < self.seed:  # items below the seed length are sought word by word
            for k in range(max(1, self.shortest), self.seed):
                h = mix(gram_hashes(w, k) ^ np.uint64(k))
                g, place = np.concatenate([g, h]), np.concatenate([place, np.arange(len(h))])
        if not len(self.keys) or not len(g):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        some = np.flatnonzero(self.maybe[g >> self.shift])
        g, place = g[some], place[some]
        i = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        ok = self.keys[i] == g
        return place[ok], i[ok]


def _short(w: np.ndarray) -> np.ndarray:
    return mix(gram_hashes(w, len(w)) ^ np.uint64(len(w)))


def align(item: np.ndarray, part: np.ndarray) -> tuple[float, int]:
    """Smith-Waterman (match 2, mismatch -1, gap -1): the best score as a share of the item's own, and where it ends in part."""
    n = len(part)
    slope = np.arange(1, n + 1)
    row = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for w in item:
        x = np.maximum(row[:-1] + np.where(part == w, 2, -1), row[1:] - 1)
        x = np.maximum(np.maximum.accumulate(np.maximum(x, 0) + slope) - slope, 0)
        row[1:] = x
        k = int(x.argmax())
        if x[k] > best:
            best, end = int(x[k]), k + 1
    return best / (2 * len(item)), end


def leaks(items: Items, w: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
    """(item id, share, first word, word after the last) of the items that leak into a sequence of word hashes."""
    place, key = items.hits(w)
    if not len(place):
        return []
    many = items.many[key]
    at = np.repeat(place, many)
    row = np.repeat(items.first[key] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    item = items.item[row]
    order = np.lexsort((at, item))
    item, at = item[order], at[order]
    out = []
    every, first, last = _runs(item)
    needs = items.need(least)[every]
    enough = last - first >= needs
    for k, need, a, z in zip(every[enough].tolist(), needs[enough].tolist(), first[enough].tolist(), last[enough].tolist()):
        x, p = items.words[k], np.unique(at[a:z])
        reach = math.ceil((3 - 2 * least) * len(x)) + items.seed
        if len(p) < need:
            continue
        c = np.flatnonzero(p[need - 1 :] - p[: len(p) - need + 1] <= reach)
        if not len(c):
            continue
        lo, hi = np.maximum(p[c] - reach, 0), np.minimum(p[c + need - 1] + reach, len(w))
        new = np.flatnonzero(lo[1:] > hi[:-1]) + 1  # stretches that overlap are one
        best = (0.0, 0, 0)
        for a, z in zip(lo[[0, *new]], hi[[*(new - 1), len(hi) - 1]]):
            if np.isin(x, w[a:z]).sum() < least * len(x) - 1e-9:  # each word of a match scores two of the item's two
                continue
            share, end = align(x, w[a:z])
            if share > best[0]:
                best = (share, int(a), int(a) + end)
        if best[0] >= least:
            share, a, end = best
            back = align(x[::-1], w[a:end][::-1])[1]  # the same alignment from its end to its first word
            out.append((items.ids[k], share, end - back, end))
    return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and ends of the runs of a sorted array."""
    start = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1])
    return x[start], start, np.concatenate([start[1:], [len(x)]])


def _blocks(bench: DataFrame, ws: Workspace) -> Iterator[list[tuple[int, str]]]:
    rows = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    blocks = -(-int(size) // BLOCK_BYTES)
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield sorted((r.item_id, r.text) for r in part.distinct().collect())


def _frequency(docs: DataFrame, items: Items) -> dict[int, int]:
    """In how many documents each n-gram of the block's items occurs (one count per n-gram and task is shuffled)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(items.keys), np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                i = items.hits(hashes_of(t))[1]
                if len(i):
                    count[np.unique(i)] += 1
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(items.keys[at].view(np.int64)), pa.array(count[at])], ["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in rows.collect()}  # at most one row for each n-gram of the block


def find(docs: DataFrame, bench: DataFrame, least: float = 0.6, seed: int = SEED) -> DataFrame:
    """doc_id, tk, item_id, share, start, end of every document and item that leaks into it."""
    ws = Workspace(docs.sparkSession, "decontam")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, tk long, item_id long, share double, start long, end long"
    out = None
    for rows in _blocks(bench, ws):
        items = Items(rows, seed)
        items.keep(_frequency(d, items))

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = []
                for doc, tk, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    got += [(doc, tk, *x) for x in leaks(items, hashes_of(t), least)]
                if got:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], ["doc_id", "tk", "item_id", "share", "start", "end"])

        found = d.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def report(docs: DataFrame, bench: DataFrame, **parameters) -> DataFrame:
    """doc_id, item_id, share, start, end."""
    return find(docs, bench, **parameters).drop("tk")


def clean(docs: DataFrame, bench: DataFrame, **parameters) -> DataFrame:
    """docs without the rows into which an item leaks; all columns stay, whatever their names."""
    ws = Workspace(docs.sparkSession, "decontam")
    rows = find(docs, bench, **parameters).select(id_key().alias("__doc"), F.col("tk").alias("__tk"))
    bad = ws.write(rows.distinct(), "leaks")
    return keyed(docs).join(bad, ["__doc", "__tk"], "left_anti").select("__row.*")
