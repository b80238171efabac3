"""Sharding by a keyed permutation of row numbers.

Rows are numbered from 0 in the order of doc_id (then of a hash of the whole row). A
Feistel network over the smallest domain of an even number of bits that holds all
numbers permutes them; a number that lands beyond the last row walks on through the
permutation until it lands on a row (cycle walking). The place p of a row gives shard
p mod shards and slot p div shards. So a row's shard and slot follow from its number,
the number of rows and the seed, and ``row_at`` finds the row of a slot without a
look-up. The law is ``rows``: shards differ by one row at most, whatever the sizes,
sources or copies among the rows.

The numbering is the only shuffle: one range exchange. Its input is written first,
so that file and place tell rows that are equal in everything apart (they can be cut
between tasks), a lost task makes the same rows again, and texts are read once. The
sorted table's files are counted, and a row's number is its place in its file behind
the rows of the files before. The driver holds one count a file.

Defined results: a null text has no bytes (size 16, checksum 0), an empty one
likewise; rows without a doc_id come first; repeated rows have numbers of their own;
an empty table gives no rows. The numbering does not depend on how the input is
partitioned. Columns pass through whatever their names; one named shard or slot is replaced.
Equal texts are not kept together: the permutation deals them out like other rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tessera.llm.common import Workspace

ROUNDS = 6
OVERHEAD = 16  # bytes that a row counts besides its text
MULTIPLIER = 0x9E3779B97F4A7C15


def round_keys(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}/{k}".encode()).digest()[:8], "big") for k in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Bits of each half of the smallest even domain that holds n numbers."""
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def _mixed(x: np.ndarray, key: int, bits: int) -> np.ndarray:
    m = np.uint64(MULTIPLIER)
    z = (x ^ np.uint64(key)) * m
    z = (z ^ (z >> np.uint64(32))) * m
    return (z >> np.uint64(32)) & np.uint64((1 << bits) - 1)


def _network(x: np.ndarray, bits: int, keys: Sequence[int], back: bool) -> np.ndarray:
    left, right = x >> np.uint64(bits), x & np.uint64((1 << bits) - 1)
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ _mixed(left, key, bits), left
        else:
            left, right = right, left ^ _mixed(right, key, bits)
    return left << np.uint64(bits) | right


def permute(numbers: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The places of row numbers below n (up to 2**63) under the permutation of a seed; ``back`` gives the numbers of places."""
    keys, bits = round_keys(seed), half_bits(n)
    out = _network(np.asarray(numbers).astype(np.uint64), bits, keys, back)
    beyond = np.flatnonzero(out >= np.uint64(n))
    while len(beyond):  # every cycle comes back to a row, at the latest to the one it began with
        out[beyond] = _network(out[beyond], bits, keys, back)
        beyond = beyond[out[beyond] >= np.uint64(n)]
    return out.astype(np.int64)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The number of the row that a slot of a shard holds."""
    place = slot * shards + shard
    if not (0 <= shard < shards and 0 <= slot and place < n):
        raise IndexError("no such slot")
    return int(permute(np.array([place]), n, seed, back=True)[0])


def _field(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def numbered(docs: DataFrame, ws: Workspace) -> tuple[DataFrame, int]:
    """(row: the columns of docs as a struct, number: 0, 1, ... in the order of doc_id), how many rows there are."""
    spark = docs.sparkSession
    whole = [_field(f.name) for f in docs.schema.fields if _hashable(f.dataType)]
    rows = ws.write(docs.select(F.struct(*map(_field, docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(*whole).alias("hash")), "rows")
    placed = rows.select("row", "id", "hash", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    ordered = ws.write(placed.orderBy(F.asc_nulls_first("id"), "hash", "file", "at").select("row"), "ordered")
    ws.drop(rows)
    files = ordered.groupBy(F.col("_metadata.file_name").alias("file")).count().collect()  # one row a file that the sort wrote
    starts, n = [], 0
    for f in sorted(files, key=lambda f: [int(x) for x in re.findall(r"^part-(\d+)|-c(\d+)", f["file"]) for x in x if x]):
        starts.append((f["file"], n))
        n += f["count"]
    starts_table = spark.createDataFrame(starts, "file string, start long")
    at = ordered.select("row", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    return at.join(F.broadcast(starts_table), "file").select("row", (F.col("start") + F.col("at")).alias("number")), n


def shuffle(docs: DataFrame, shards: int = 40, seed: int = 1) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (0, 1, ... within a shard), in the shuffled order of the seed."""
    if shards < 1:
        raise ValueError("at least one shard")
    rows, n = numbered(docs, Workspace(docs.sparkSession, "sharding"))

    @pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    placed = rows.select("row", place("number").alias("place"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*kept, F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def write(sharded: DataFrame, path: str) -> None:
    """Shards as folders shard=0, shard=1, ...; a shard may have several files, whose order by name is that of the slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = 40, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; texts are read once and not shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    out = shuffle(narrow, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def oracle(shards: int = 40, seed: int = 1) -> str:
    """The same in SQL: checksums by a table of 256 entries, the network and its walk by recursion, a round a step."""
    keys = "[" + ", ".join(f"{k}::UBIGINT" for k in round_keys(seed)) + "]"
    times = lambda x: f"(({x})::UHUGEINT * {MULTIPLIER}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"""WITH RECURSIVE bits AS (SELECT i::BIGINT AS i, i::BIGINT AS x, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(x ORDER BY i) AS t FROM bits WHERE k = 8),
hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS number, count(*) OVER () AS n FROM documents),
bytes AS (SELECT *, [4294967295] || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM hexed),
d AS (SELECT doc_id, number, n, length(h) // 2 + {OVERHEAD} AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM bytes, tab),
w AS (SELECT number, n::UBIGINT AS n, (SELECT min(k) FROM range(1, 32) t(k) WHERE pow(4, k) >= n) AS k FROM d),
s AS (SELECT number, n, k, number::UBIGINT >> k AS l, number::UBIGINT & ((1::UBIGINT << k) - 1) AS r, 0 AS step FROM w
  UNION ALL SELECT number, n, k, r, xor(l, {times("xor(z, z >> 32)")} >> 32 & ((1::UBIGINT << k) - 1)), step + 1
  FROM (SELECT *, {times(f"xor(r, {keys}[step % {ROUNDS} + 1])")} AS z FROM s WHERE step = 0 OR step % {ROUNDS} > 0 OR (l << k | r) >= n)),
p AS (SELECT number, arg_max(l << k | r, step)::BIGINT AS place FROM s GROUP BY number)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place % {shards} AS INTEGER) AS shard, CAST(place // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM d JOIN p USING (number)"""
