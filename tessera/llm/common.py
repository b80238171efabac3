"""Helpers shared by the training-data operators: shared storage, words, hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)  # the key under which rows with a null doc_id are grouped; below every real id
_MADE: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Local runs without it get one of their own; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """Written tables in the shared folder: they cut lineage and survive lost executors.

    Each table is a Parquet folder. The operator that makes a workspace owns it: it
    drops the tables that its result does not read (``drop_but``). The tables behind
    a result belong to whoever holds the result and go when the driver process ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._tables: list[str] = []
        self._names: dict[str, str] = {}
        _MADE.append((spark, self.root))

    def path(self, table: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{table}"

    def write(self, df: DataFrame, table: str, clean: bool = False) -> DataFrame:
        """df as a table. ``clean``: its shuffle files go as soon as the table is written, not when the driver next collects garbage."""
        path = self.path(table)
        with self._cleaning(clean):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        self._tables.append(path)
        return out

    @contextmanager
    def _cleaning(self, clean: bool) -> Iterator[None]:
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        try:
            if clean:
                self.spark.conf.set(key, "true")
            yield
        finally:
            if clean:
                self.spark.conf.set(key, before) if before is not None else self.spark.conf.unset(key)

    def write_sorted(self, df: DataFrame, table: str, keys: list[str], clean: bool = False) -> DataFrame:
        """df as a table bucketed and sorted by ``keys``: joins on them need no shuffle, nor (under ``sorted_runs``) a sort.

        df should come out of a shuffle by these keys, so that each bucket is one file.
        """
        path, name = self.path(table), f"tessera_{uuid.uuid4().hex}"
        parts = shuffle_partitions(self.spark)
        with self._cleaning(clean):
            df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, *keys).sortBy(*keys).saveAsTable(name)
        out = self.spark.table(name)
        out._tessera_path, self._names[path] = path, name
        self._tables.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if t._tessera_path in self._names:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop(t._tessera_path)}")
            remove(self.spark, t._tessera_path)
            self._tables = [x for x in self._tables if x != t._tessera_path]


    def drop_but(self, *kept: DataFrame) -> None:
        """Remove all tables of this workspace but these."""
        stay = {t._tessera_path for t in kept}
        for path in [t for t in self._tables if t not in stay]:
            if path in self._names:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop(path)}")
            remove(self.spark, path)
        self._tables = [t for t in self._tables if t in stay]


@contextmanager
def sorted_runs(spark: SparkSession) -> Iterator[None]:
    """Within it, bucketed tables with one file a bucket are read as sorted.

    A union of bucketed tables must not pass for bucketed there: Spark 4.1 reads it
    column by column without aligning the buckets, and sums by key come out in parts.
    """
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, root in _MADE:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, root)
        except Exception:  # the JVM may be gone already
            return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame) -> DataFrame:
    """__row (all columns of docs as one struct, so none can clash), __doc, __tk."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), id_key().alias("__doc"), text_key().alias("__tk"))


def id_key(col: str | Column = "doc_id") -> Column:
    """doc_id as a grouping key: null ids are one document that sorts before all others."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(NULL_ID))


def text_key(col: str = "text") -> Column:
    """64-bit identity of a row's text, so repeated doc_ids with other texts stay apart."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


#: Bytes that part words, and those of A-Z as a-z, the others as they are.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PIECE = 1 << 20  # bytes that are hashed at once
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    base = 0x9E3779B97F4A7C15
    steps = [np.full(n, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    for x in steps:
        x[0] = 1
    return np.multiply.accumulate(steps[0]), np.multiply.accumulate(steps[1])


def hash_words(text: bytes, fold: np.ndarray | None = None, spaces: np.ndarray = SPACES) -> np.ndarray:
    """64-bit hashes (uint64) of the words of a text, in order; ``fold`` maps its bytes first.

    A word's hash is a polynomial of its bytes, read off running sums over the text, so
    no word is looked at by itself.
    """
    x = np.frombuffer(text, np.uint8)
    if fold is not None:
        x = fold[x]
    if len(x) <= _PIECE:
        return _hash_piece(x, spaces)
    out, a, gaps = [], 0, np.flatnonzero(spaces[x])
    while a < len(x):
        i = int(np.searchsorted(gaps, a + _PIECE))
        z = len(x) if i >= len(gaps) or a + _PIECE >= len(x) else int(gaps[i])
        out.append(_hash_piece(x[a:z], spaces))
        a = z
    return np.concatenate(out)


def _hash_piece(x: np.ndarray, spaces: np.ndarray) -> np.ndarray:
    n = len(x)
    part = np.ones(n + 2, bool)
    part[1:-1] = spaces[x]
    edges = np.flatnonzero(part[1:] != part[:-1])
    first, last = edges[::2], edges[1::2]
    if not len(first):
        return np.empty(0, np.uint64)
    up, down = _powers(max(1 << 16, 1 << (n - 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[x] * up[:n], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of a sequence of word hashes (uint64); empty if it is shorter."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    w = words.view(np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * MULT + w[k : k + m]
    return mix(h)


def give_back() -> None:
    """Return what a task has freed to the system: Python workers live on, and tasks of other stages run in them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def texts_of(batch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a string column of an Arrow batch; null counts as empty."""
    for x in batch.column(batch.schema.get_field_index(name)):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""
