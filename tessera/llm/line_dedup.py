"""Line dedup over levelled sorted runs of line keys.

A run is a Parquet table of (k1, k2, n_docs, max_doc), bucketed and sorted by the
128-bit key of the normalised line, with the number of a batch's documents that
hold it and the largest of their ids. A new batch is aggregated to such rows and
merge-anti-joined with the runs, which needs neither shuffle nor sort on their
side: keys that no run holds are added as a run of level 0, so a key stands in one
run only. Sightings of known keys go to deltas. When a level holds ``fanout`` runs
they are merged into one run of the next level. What the batches repeat is read off
the runs, each joined with the sum of the deltas.

A line is dropped if its key is at least ``min_chars`` long, is held by at least
``min_docs`` documents, and the document is not the one with the largest id. Keys
of more than ``HOT`` documents (or a 100,000th of all sightings, if that is more:
so there are at most 100,000 of them) meet the lines that hold them by a broadcast;
all others by a shuffle.

Defined results: null text is one empty line; rows that share a doc_id are one
document; all rows with a null doc_id are one document below every other; an
empty table gives an empty result; extra columns are kept by ``dedup``, whatever
their names, and ignored by the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, id_key, keyed, sorted_runs, text_key

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HOT, HOT_KEYS = 100_000, 100_000
KEY = ["k1", "k2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_text(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def long_lines(text: Column, min_chars: int) -> Column:
    """(k1, k2, pos) of the text's lines whose keys have at least ``min_chars`` code points."""
    rows = F.transform(lines_of(text), lambda x, i: F.struct(F.when(F.char_length(x) >= min_chars, key_text(x)).alias("k"), i.alias("pos")))
    rows = F.filter(rows, lambda r: F.char_length(r["k"]) >= min_chars)
    return F.transform(rows, lambda r: F.struct(F.xxhash64(r["k"]).alias("k1"), F.xxhash64(F.lit(7), r["k"]).alias("k2"), r["pos"].alias("pos")))


def sightings(docs: DataFrame, min_chars: int) -> DataFrame:
    """k1, k2, n_docs, max_doc of a batch of documents."""
    keys = F.array_distinct(F.transform(long_lines(F.col("text"), min_chars), lambda r: F.struct(r["k1"].alias("k1"), r["k2"].alias("k2"))))
    rows = docs.select(id_key().alias("doc"), F.explode(keys).alias("k")).select("k.k1", "k.k2", "doc").distinct()
    return rows.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_doc"))


class LineRuns:
    """Levelled sorted runs of line keys in a shared folder."""

    def __init__(self, ws: Workspace, fanout: int = 4, min_chars: int = 40) -> None:
        self.ws, self.fanout, self.min_chars = ws, fanout, min_chars
        self.levels: list[list[DataFrame]] = [[]]
        self.deltas: list[DataFrame] = []
        self.merged: list[DataFrame] = []  # runs that a compaction replaced; whoever got them from ``append`` may still read them

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def append(self, docs: DataFrame) -> DataFrame:
        """Add a batch of documents (no document may be spread over two batches); returns the new run: the keys never seen before."""
        with sorted_runs(self.ws.spark):
            own = self.ws.write_sorted(sightings(docs, self.min_chars), "batch", KEY)
            run = own
            if runs := self.runs():
                fresh = own
                for r in runs:
                    fresh = fresh.join(r.select(*KEY).hint("merge"), KEY, "left_anti")
                run = self.ws.write_sorted(fresh, "run", KEY)
                known = own.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
                self.deltas.append(self.ws.write_sorted(known, "delta", KEY))
                self.ws.drop(own)
            self.levels[0].append(run)
            self._compact()
            return run

    def admit(self, docs: DataFrame) -> DataFrame:
        """k1, k2, max_doc of the new keys of a batch, which is then part of the runs."""
        return self.append(docs).select(*KEY, "max_doc")

    def _compact(self) -> None:
        for level in range(64):
            if level >= len(self.levels) or len(self.levels[level]) < self.fanout:
                break
            merged = self.ws.write_sorted(_all(self.levels[level]).repartition(*KEY), "run", KEY)  # their keys are disjoint
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            self.merged += old
        if len(self.deltas) >= self.fanout:
            old, self.deltas = self.deltas, [self.ws.write_sorted(_sum(self.deltas), "delta", KEY)]
            self.ws.drop(*old)

    def close(self) -> None:
        self.ws.drop(*self.runs(), *self.deltas, *self.merged)
        self.levels, self.deltas, self.merged = [[]], [], []

    def repeated(self, min_docs: int) -> DataFrame:
        """k1, k2, n_docs, max_doc of the keys that at least ``min_docs`` documents hold."""
        out = None
        more = None
        if self.deltas:
            more = self.deltas[0] if len(self.deltas) == 1 else _sum(self.deltas)
            more = more.select(*KEY, F.col("n_docs").alias("__n"), F.col("max_doc").alias("__m")).hint("merge")
        for r in self.runs():
            if more is not None:
                r = r.join(more, KEY, "left").select(*KEY, (F.col("n_docs") + F.coalesce("__n", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "__m").alias("max_doc"))
            r = r.where(F.col("n_docs") >= min_docs)
            out = r if out is None else out.unionByName(r)
        return out


def _all(runs: list[DataFrame]) -> DataFrame:
    rows = runs[0]
    for r in runs[1:]:
        rows = rows.unionByName(r)
    return rows


def _sum(runs: list[DataFrame]) -> DataFrame:
    return _all(runs).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))


def build_runs(docs: DataFrame, ws: Workspace, batches: int = 3, fanout: int = 2, min_chars: int = 40) -> LineRuns:
    index = LineRuns(ws, fanout, min_chars)
    for b in range(batches):
        index.append(docs.where(F.pmod(F.xxhash64(id_key()), F.lit(batches)) == b) if batches > 1 else docs)
    return index


def dropped(docs: DataFrame, ws: Workspace, min_chars: int = 40, min_docs: int = 5, batches: int = 3) -> DataFrame:
    """__doc, __tk, __drop: the places of the lines to drop, for the rows that lose any."""
    docs = docs.select("doc_id", "text")
    index = build_runs(docs, ws, batches, min_chars=min_chars)
    with sorted_runs(ws.spark):
        often = ws.write(index.repeated(min_docs), "repeated")
    index.close()
    most = max(HOT, (often.agg(F.sum("n_docs")).first()[0] or 0) // HOT_KEYS)
    hot = often.where(F.col("n_docs") > most).select(*KEY, F.col("max_doc").alias("hot_doc"))  # at most 100,000 rows
    rows = docs.select(id_key().alias("doc"), text_key().alias("tk"), F.explode(long_lines(F.col("text"), min_chars)).alias("k")).select("k.*", "doc", "tk")
    rows = rows.join(F.broadcast(hot), KEY, "left")
    # Lines of hot keys are decided already; a key of their own spreads them.
    rows = rows.withColumn("k1", F.when(F.col("hot_doc").isNull(), F.col("k1")).otherwise(F.xxhash64("k1", "doc", "pos")))
    rest = often.where(F.col("n_docs") <= most).select(*KEY, "max_doc").hint("merge")
    rows = rows.join(rest, KEY, "left").withColumn("last", F.coalesce("hot_doc", "max_doc")).where("doc <> last")
    return rows.groupBy(F.col("doc").alias("__doc"), F.col("tk").alias("__tk")).agg(F.collect_set("pos").alias("__drop"))


def _kept(text: str | None, drop: list[int] | None) -> tuple[list[str], int]:
    lines = (text or "").split("\n")
    n = len(lines)
    if drop:
        gone = set(drop)
        lines = [x for i, x in enumerate(lines) if i not in gone]
    return lines, n


def dedup(docs: DataFrame, **parameters) -> DataFrame:
    """docs with text replaced by the kept lines; all columns stay, whatever their names."""
    ws = Workspace(docs.sparkSession, "line-dedup")
    j = keyed(docs).join(dropped(docs, ws, **parameters), ["__doc", "__tk"], "left")
    names, where = docs.columns, docs.columns.index("text")
    rows = j.select("__row.*", "__drop").toDF(*[f"c{i}" for i in range(len(names) + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = ["\n".join(_kept(t, d)[0]) for t, d in zip(b.column(where).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            cols = [pa.array(text, pa.string()) if i == where else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, docs.schema)


def digest(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per row of docs."""
    spark: SparkSession = docs.sparkSession
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    j = keyed(own).join(dropped(own, Workspace(spark, "line-dedup"), **parameters), ["__doc", "__tk"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k, sha = [], [], []
            for t, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                lines, many = _kept(t, d)
                n.append(many), k.append(many - len(lines)), sha.append(hashlib.sha256("\n".join(lines).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return j.select(F.col("__row.doc_id").cast("long").alias("doc_id"), "__row.text", "__drop").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


__all__ = ["LineRuns", "build_runs", "dedup", "digest", "dropped"]
