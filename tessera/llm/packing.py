"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two of
n's binary form (as many of the largest length as fit, then one per set bit).
Pieces of equal length form a bucket and every piece is a sequence by itself, so
no sequence crosses documents and none needs padding.

Defined results: a null or empty text has only the end token (one piece of
length 1); repeated rows are packed as often as they occur, each with its own
sequence_id; a null doc_id is carried as null; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back

_OTHER = re.compile("[^\\x00-\u024f]")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_names() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Token ids (little-endian uint32 bytes) of whole texts, as the tokenizer file gives them.

    Texts of Latin letters are merged by a faster engine that is built from the
    vocabulary of the same file; any other text, and one that holds the string of a
    special token, goes through the tokenizer itself. Both give the same ids (the
    tests compare them). ``specials_as_text``: such strings are ordinary text.
    """

    def __init__(self, path: str, specials_as_text: bool = False) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = specials_as_text
        byte = _byte_names()
        ranks = {bytes(byte[c] for c in w): i for w, i in self.tok.get_vocab(with_added_tokens=False).items() if all(c in byte for c in w)}
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        ranks = {w: i for w, i in ranks.items() if w.decode("utf-8", "replace") not in special}
        self.slow = re.compile("|".join([_OTHER.pattern, *map(re.escape, sorted(special - {""}))]))
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.slow.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


def piece_lengths(n: int, longest: int) -> list[int]:
    """The binary decomposition of n with no part over ``longest`` (a power of two), longest first."""
    out = [longest] * (n // longest)
    rest = n % longest
    bit = longest >> 1
    while rest:
        if rest >= bit:
            out.append(bit)
            rest -= bit
        bit >>= 1
    return out


def pack(docs: DataFrame, encoder: Callable[[], Encoder] | None = None, longest: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, bucket, ids_crc32, doc_tokens, sequence_id, offset and, if asked, the ids.

    ``longest`` must be a power of two. One pass, no shuffle: the ids of a
    sequence are the row's place in the (fixed) input splits, so a retried task
    gives the same ones.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = tokenizer_path() if encoder is None else None
    tail = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, start long, length long, bucket int, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder() if encoder is not None else Encoder(path)
        for b in batches:
            rows: list[tuple] = []
            ids_out: list[bytes] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.encode(text or "") + tail
                n, at = len(ids) // 4, 0
                for m in piece_lengths(n, longest):
                    part = ids[4 * at : 4 * (at + m)]
                    rows.append((doc_id, at, m, m.bit_length() - 1, zlib.crc32(part), n))
                    if with_ids:
                        ids_out.append(part)
                    at += m
                if len(rows) >= 20_000 or with_ids and rows and n > 1_000_000:
                    yield _batch(rows, ids_out, with_ids)
                    rows, ids_out = [], []
            if rows:
                yield _batch(rows, ids_out, with_ids)
        del enc
        give_back()

    out = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def _batch(rows: list[tuple], ids: list[bytes], with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows))
    arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())]
    names = ["doc_id", "start", "length", "bucket", "ids_crc32", "doc_tokens"]
    if with_ids:
        ends = np.concatenate([[0], np.cumsum(cols[2])]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)
