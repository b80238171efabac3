"""N-gram Jaccard self-join of documents, to components.

1. One pass hashes every text to its set of distinct 5-word shingles. Texts with
   the same set are one class (its key is a 64-bit order-free hash of the set),
   so exact copies never meet pairwise. Tasks deal their classes' shingles to
   shards as packed arrays of four bytes a shingle; a shard counts in how many
   classes each occurs and answers for those that occur in two or more.
2. The answers of a block of documents come together. Rarest first is the order:
   shingles of one class come before all others and can match nothing, so of the
   prefix (a quarter of the set plus one) only what is left after them is dealt
   on, and a class whose prefix they fill can link with nothing.
3. A shard joins the prefixes. Length, positional and suffix filters (the last
   bounds the overlap by 16 hash buckets of the whole sets) cut the pairs.
   Shingles of at most ``SMALL`` classes give all their pairs; of more, and of
   those salted over several shards, the pairs with the first, and the members
   are kept.
4. Each pair is verified once, exactly, on the texts. Linked classes are joined
   to components. Kept members of different components then meet by component
   leaders, round by round while that links anything, and last all the
   remaining pairs across components, so no link is lost and no large group of
   copies is expanded.

Defined results: empty texts and null doc_ids are linked with nothing (a null
id's component is null); rows that share a doc_id and a set are one class; rows
that share a doc_id with different sets keep their own class; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, MULT, Workspace, gram_hashes, hash_words, keyed, mix, shuffle_partitions, text_key, texts_of
from tessera.llm.components import components

SMALL = 6
TOKENS_PER_SHARD = 3_000_000
BLOCK = 1_000_000  # shingles that a task deals at once
HEAVY = 1_000_000  # a shingle of more classes is salted over several shards
CHARS_PER_SHINGLE = 6  # to size the shards from the texts' lengths
BITS = 24  # log2 of the bits of the filter on texts to fetch
STAR_ROUNDS = 6
HOT, HOT_KEYS = 1_000, 10_000
PAIRED = 64  # members of a posting that are left are paired by a join up to this many, block against block beyond
MEMBERS = 1_024  # in a block
BUCKETS = 256  # of the sketches that bound the overlap of those members


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct n-word shingles (uint64); one for all words if there are fewer than n."""
    w = hash_words(text, LOWER)
    if len(w) >= n or not len(w):
        return np.unique(gram_hashes(w, n))
    h = np.uint64(len(w))
    with np.errstate(over="ignore"):
        for x in w:
            h = h * MULT + x
    return mix(np.array([h ^ np.uint64(0xABCDEF)], np.uint64))


def class_key(s: np.ndarray) -> int:
    """Order-free 64-bit hash of a set."""
    if not len(s):
        return 0
    t = mix(s + np.uint64(0x51ED270B))
    with np.errstate(over="ignore"):
        v = mix(np.array([t.sum() ^ (np.bitwise_xor.reduce(t) * MULT) ^ np.uint64(len(s))], np.uint64))[0]
    return int(v.view(np.int64))


def _deal_all(docs: DataFrame, shards: int, n: int) -> DataFrame:
    """Packed rows. shard >= 0: the shingles of a block's new classes that fall there. shard < 0: the block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        ids, tks, cs, sizes, new, n_new, made = [], [], [], [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            block = (TaskContext.get().partitionId() << 32) + made  # a retried task numbers its blocks alike
            made += 1
            rows = [(-1 - block % shards, block, _arrays(np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], np.uint8), np.array(tks, np.int64), np.array(cs, np.int64), np.array(sizes, np.int32)))]
            if new:
                cls = np.array([x[0] for x in new], np.int64)
                tok = np.concatenate([x[1] for x in new])
                doc = np.repeat(np.arange(len(new), dtype=np.int32), [len(x[1]) for x in new])
                sig = np.array([np.minimum(np.bincount((x[1] >> np.uint64(60)).astype(np.int64), minlength=16), 255) for x in new], np.uint8)
                # A shingle that several classes of the block hold is sent once, with their number; the block keeps who holds it.
                name, inv, many = np.unique(tok, return_inverse=True, return_counts=True)
                both = many > 1
                often = both[inv]
                place = (np.cumsum(both) - 1)[inv[often]].astype(np.int32)
                home = lambda t: ((t >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
                known = (home(name[both]).astype(np.uint64) << np.uint64(32)) | name[both].astype(np.uint32)
                rows.append((-1 - block % shards, -1 - block, _arrays(cls, np.array([len(x[1]) for x in new], np.int32), sig, doc[often], place, known)))
                tok, doc, times = tok[~often], doc[~often], many[both].astype(np.int32)
                shard = home(tok)
                order, at = np.argsort(shard, kind="stable"), np.argsort(home(name[both]), kind="stable")
                low, doc, shard, common, common_at = tok[order].astype(np.uint32), doc[order], shard[order], name[both][at].astype(np.uint32), home(name[both])[at]
                for k in np.union1d(shard, common_at):
                    (a, z), (c, e) = np.searchsorted(shard, [k, k + 1]), np.searchsorted(common_at, [k, k + 1])
                    d, per = np.unique(doc[a:z], return_counts=True)
                    rows.append((int(k), block, _arrays(d, per.astype(np.int32), cls[d], low[a:z], common[c:e], times[at][c:e])))
            for x in (ids, tks, cs, sizes, new):
                x.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "block", "blob"])

        for b in batches:
            for doc_id, tk, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b)):
                s = shingles(t, n)
                c = class_key(s)
                ids.append(doc_id), tks.append(tk), cs.append(c), sizes.append(len(s))
                if len(s) and c not in seen:
                    if len(seen) < 2_000_000:
                        seen.add(c)
                    new.append((c, s))
                    n_new += len(s)
                if n_new >= BLOCK or len(ids) >= 200_000:
                    yield from flush()
                    n_new = 0
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("tk"), "text").mapInArrow(run, "shard int, block long, blob binary")


def _arrays(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, with their types and lengths before them."""
    head = [len(arrays)]
    for a in arrays:
        head += [_KINDS.index(a.dtype.str[1:]), a.shape[0], a.shape[1] if a.ndim == 2 else 0]
    return np.array(head, np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _of(blob) -> list[np.ndarray]:
    k = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 3 * k, 8)
    at, out = 8 + 24 * k, []
    for i in range(k):
        kind, n, m = np.dtype(_KINDS[head[3 * i]]), int(head[3 * i + 1]), int(head[3 * i + 2])
        a = np.frombuffer(blob, kind, n * max(m, 1), at)
        out.append(a.reshape(n, m) if m else a)
        at += a.nbytes
    return out


_KINDS = ["i8", "u8", "i4", "u4", "u1", "u2"]


def _count(dealt: DataFrame) -> DataFrame:
    """kind 0: a document's doc_id, tk, c, size. kind 1: a block's answers (block, blob)."""
    schema = "kind int, doc_id long, tk long, c long, size int, block long, blob binary"
    names = ["kind", "doc_id", "tk", "c", "size", "block", "blob"]

    def answers(blocks: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        k = len(blocks)
        return pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), *[pa.nulls(k, pa.int64())] * 3, pa.nulls(k, pa.int32()), pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary())], names)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0].as_py()
        asked = []
        for b in batches:
            f = b.schema.get_field_index
            for block, x in zip(b.column(f("block")).to_pylist(), b.column(f("blob"))):
                blob = x.as_buffer().to_pybytes()
                if shard >= 0:
                    asked.append((block, *_of(blob)))
                elif block < 0:
                    yield answers([-1 - block], [blob])
                else:
                    ids, null, tk, c, size = _of(blob)
                    k = len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), pa.array(ids, mask=null.astype(bool)), pa.array(tk), pa.array(c), pa.array(size), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names)
        if not asked:
            return
        low = np.concatenate([a[4] for a in asked])
        cls = np.concatenate([np.repeat(a[3], a[2]) for a in asked]).view(np.uint64)
        first = np.unique(mix(cls + low * MULT), return_index=True)[1]  # each class once
        name, inv = np.unique(np.concatenate([low[first], *(a[5] for a in asked)]), return_inverse=True)
        many = np.bincount(inv, weights=np.concatenate([np.ones(len(first)), *(a[6] for a in asked)])).astype(np.int64)
        del cls, inv, first
        name, many = name[many > 1], many[many > 1]
        if not len(name):
            return
        for block, d, per, _, lo, common, _ in asked:
            i = np.minimum(np.searchsorted(name, lo), len(name) - 1)
            ok = name[i] == lo
            if ok.any() or len(common):
                tok = lambda x: x.astype(np.uint64) | np.uint64(shard << 32)
                of = many[np.searchsorted(name, common)].astype(np.int64)
                yield answers([block], [_arrays(np.repeat(d, per)[ok], tok(lo[ok]), many[i[ok]], tok(common), of)])

    return dealt.groupBy("shard").applyInArrow(run, schema)


def _deal_prefix(answers: DataFrame, shards: int, num: int, den: int) -> DataFrame:
    """What is left of each class's prefix after the shingles of one class, dealt by shingle."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, tok, often, known, times, head = [], [], [], [], [], None
        for b in batches:
            for x in b.column(b.schema.get_field_index("blob")):
                got = _of(x.as_buffer().to_pybytes())
                if got[2].ndim == 2:
                    head = got
                else:
                    doc.append(got[0]), tok.append(got[1]), often.append(got[2]), known.append(got[3]), times.append(got[4])
        if head is None or not doc:
            return
        cls, size, sig, held, place, common = head
        known, times = np.concatenate(known), np.concatenate(times)
        order = np.argsort(known)
        doc, tok, often = np.concatenate([*doc, held]), np.concatenate([*tok, common[place]]), np.concatenate([*often, times[order][np.searchsorted(known[order], common)][place] if len(held) else np.empty(0, np.int64)])
        order = np.lexsort((tok, often, doc))
        doc, tok, often = doc[order], tok[order], often[order]
        shared = np.bincount(doc, minlength=len(cls))
        first = np.cumsum(shared) - shared
        pos = np.arange(len(doc)) - first[doc] + (size.astype(np.int64) - shared)[doc]
        ok = pos < prefix_length(size.astype(np.int64), num, den)[doc]
        doc, tok, often, pos = doc[ok], tok[ok], often[ok], pos[ok]
        if not len(doc):
            return
        heavy = often > HEAVY
        salt = np.where(heavy, cls[doc].view(np.uint64) % (often.astype(np.uint64) // np.uint64(HEAVY) + np.uint64(1)), np.uint64(0))
        shard = (mix(tok + (salt << np.uint64(50))) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        tok, doc, pos, shard, heavy = tok[order], doc[order], pos[order], shard[order], heavy[order]
        cut = np.flatnonzero(np.diff(shard)) + 1
        ids, blobs = [], []
        for a, z in zip([0, *cut], [*cut, len(shard)]):
            d, inv = np.unique(doc[a:z], return_inverse=True)
            ids.append(int(shard[a]))
            blobs.append(_arrays(cls[d], size[d], sig[d], tok[a:z], inv.astype(np.int32), pos[a:z].astype(np.int32), np.unique(tok[a:z][heavy[a:z]])))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    return answers.groupBy("block").applyInArrow(run, "shard int, blob binary")


def _gather(rows: DataFrame, column: str, chunks: int, each: int) -> bytes:
    """A fixed-size table (``chunks * each`` bytes at most) from its chunks."""
    got = {r["chunk"]: bytes(r[column]) for r in rows.collect()}
    return b"".join(got.get(i, b"\0" * each) for i in range(chunks))


def prefix_length(size: np.ndarray | int, num: int, den: int):
    """size - ceil(size * num / den) + 1"""
    return size - -(-size * num // den) + 1


def bound(sa, sb, pa_, pb_):
    """The largest overlap of two sets whose first common shingle is at places pa_ and pb_ of one total order.

    Every pair that links has a first common shingle, so it is enough to find it
    there; at later ones the bound leaves most pairs out.
    """
    return np.minimum(sa - pa_, sb - pb_)


def apart(p: np.ndarray, q: np.ndarray, most: int, depth: int = 4) -> int:
    """The suffix filter: a lower bound of how many members two sorted sets do not share (exact beyond ``most`` does not matter).

    The middle member of one set parts both; what lies on different sides cannot be
    shared, so the sizes of the sides bound the difference, again and again in each.
    """
    least = abs(len(p) - len(q))
    if least > most or not depth or not len(p) or not len(q):
        return least
    k = len(p) // 2
    i = int(np.searchsorted(q, p[k]))
    there = i < len(q) and q[i] == p[k]
    right = q[i + 1 :] if there else q[i:]
    own = 0 if there else 1
    beyond = abs(len(p) - k - 1 - len(right))
    first = apart(p[:k], q[:i], most - own - beyond, depth - 1)
    if own + first + beyond > most:
        return own + first + beyond
    return own + first + apart(p[k + 1 :], right, most - own - first, depth - 1)


def _candidates(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """kind 0: a pair of classes a < b. kind 1: a member of a large posting: a = shingle, b = class, size, pos."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, size, sig, tok, doc, pos, salted, base = [], [], [], [], [], [], [], 0
        for b in batches:
            for x in b.column(b.schema.get_field_index("blob")):
                c, s, g, t, d, p, h = _of(x.as_buffer().to_pybytes())
                cls.append(c), size.append(s), sig.append(g), tok.append(t), pos.append(p), salted.append(h)
                doc.append(d + np.int32(base))
                base += len(c)
        cls, size, sig, tok, doc, pos, salted = (np.concatenate(x) for x in (cls, size, sig, tok, doc, pos, salted))
        cls, first, inv = np.unique(cls, return_index=True, return_inverse=True)
        size, sig, doc = size[first].astype(np.int64), sig[first].astype(np.int32), inv[doc]
        sig[sig == 255] = 1 << 30
        order = np.lexsort((doc, tok))
        tok, doc, pos = tok[order], doc[order], pos[order].astype(np.int64)
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1])
        tok, doc, pos = tok[new], doc[new], pos[new]
        order = np.lexsort((doc, pos, tok))  # the class with the fewest shingles of its own leads: it is nearest the middle of a group
        tok, doc, pos = tok[order], doc[order], pos[order]
        start = np.ones(len(tok), bool)
        start[1:] = tok[1:] != tok[:-1]
        at = np.flatnonzero(start)
        many = np.diff([*at, len(tok)])
        group = np.repeat(np.arange(len(at)), many)
        wide = (many[group] > SMALL) | np.isin(tok, salted)  # this shard has only a part of a salted posting
        found: list[np.ndarray] = []

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            for z in range(0, len(i), 500_000):
                x, y = i[z : z + 500_000], j[z : z + 500_000]
                sa, sb = size[doc[x]], size[doc[y]]
                ok = den * np.minimum(sa, sb) >= num * np.maximum(sa, sb)
                need = -(-(sa + sb) * num // (num + den))
                ok &= bound(sa, sb, pos[x], pos[y]) >= need
                x, y, need = x[ok], y[ok], need[ok]
                ok = np.minimum(sig[doc[x]], sig[doc[y]]).sum(1) >= need
                if ok.any():
                    p, q = np.minimum(doc[x[ok]], doc[y[ok]]), np.maximum(doc[x[ok]], doc[y[ok]])
                    found.append(np.unique(p.astype(np.int64) * len(cls) + q))

        for k in range(1, SMALL):
            i = np.flatnonzero((group[k:] == group[:-k]) & ~wide[k:]) if len(tok) > k else np.empty(0, np.int64)
            keep(i, i + k)
        big = np.flatnonzero(wide)
        if len(big):
            lead = at[group[big]]
            keep(lead[lead != big], big[lead != big])
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        for z in range(0, len(pairs), 50_000):
            q = pairs[z : z + 50_000]
            yield _rows(0, cls[q // len(cls)], cls[q % len(cls)], None, None)
        for z in range(0, len(big), 50_000):
            q = big[z : z + 50_000]
            yield _rows(1, tok[q].view(np.int64), cls[doc[q]], size[doc[q]], pos[q])

    return dealt.groupBy("shard").applyInArrow(run, "kind int, a long, b long, size int, pos int")


def _rows(kind: int, a: np.ndarray, b: np.ndarray, size, pos) -> pa.RecordBatch:
    n = len(a)
    none = pa.nulls(n, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b), none if size is None else pa.array(size.astype(np.int32)), none if pos is None else pa.array(pos.astype(np.int32))], ["kind", "a", "b", "size", "pos"])


class _Verifier:
    """Exact Jaccard checks of pairs of classes on the texts of one member each."""

    def __init__(self, ws: Workspace, docs: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> None:
        self.ws, self.docs, self.sets = ws, docs, sets
        self.n, self.num, self.den = n, num, den
        self.checked: DataFrame | None = None
        self.links: DataFrame | None = None

    def texts(self, pairs: DataFrame) -> DataFrame:
        """c, text of the classes in ``pairs``."""
        need = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
        one = self.sets.where("doc_id is not null").join(need, "c", "left_semi").groupBy("c").agg(F.min(F.struct("doc_id", "tk")).alias("r")).select("c", "r.doc_id", "r.tk")
        one = self.ws.write(one, "needed")
        bits = _gather(_bitmap(one), "bits", 1 << (BITS - 15), 1 << 12)
        shared = self.ws.spark.sparkContext.broadcast(bits)  # 2 MB, a fixed size; false hits only cost a shuffled row

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.frombuffer(shared.value, np.uint8)
            for b in batches:
                at = _bit(b.column(1).to_numpy(zero_copy_only=False))
                yield b.filter(pa.array((table[at >> 3] >> (at & 7)) & 1 == 1))

        rows = self.docs.select(F.col("doc_id").cast("long"), text_key().alias("tk"), F.col("text").cast("string")).where("doc_id is not null")
        rows = rows.mapInArrow(run, "doc_id long, tk long, text string")
        return self.ws.write(rows.join(one, ["doc_id", "tk"]).groupBy("c").agg(F.first("text").alias("text")), "texts")

    def check(self, pairs: DataFrame) -> int:
        """Verify pairs (a, b, not seen before); the number of new links."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.checked is not None:
            pairs = pairs.join(self.checked, ["a", "b"], "left_anti")
        pairs = self.ws.write(pairs, "pairs")
        if pairs.isEmpty():
            return 0
        self.checked = pairs if self.checked is None else self.checked.unionByName(pairs)
        t = self.texts(pairs)
        j = pairs.join(t.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b").join(t.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a")
        n, num, den = self.n, self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = {}

            def of(c: int, text: bytes) -> np.ndarray:
                s = memo.get(c)
                if s is None:
                    if len(memo) > 256:
                        memo.clear()
                    s = memo[c] = shingles(text, n)
                return s

            for b in batches:
                a_, b_ = b.column(0).to_pylist(), b.column(1).to_pylist()
                ok = []
                for x, y, tx, ty in zip(a_, b_, texts_of(b, "ta"), texts_of(b, "tb")):
                    p, q = of(x, tx), of(y, ty)
                    need = -(-(len(p) + len(q)) * num // (num + den))
                    if apart(p, q, len(p) + len(q) - 2 * need) > len(p) + len(q) - 2 * need:
                        ok.append(False)
                        continue
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(den * common >= num * (len(p) + len(q) - common))
                m = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(m), b.column(1).filter(m)], ["u", "v"])

        new = self.ws.write(j.select("a", "b", "ta", "tb").mapInArrow(run, "u long, v long"), "links")
        self.links = new if self.links is None else self.links.unionByName(new)
        self.ws.drop(t)
        return new.count()


def _bit(tk: np.ndarray) -> np.ndarray:
    return (mix(tk.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def _bitmap(rows: DataFrame) -> DataFrame:
    """chunk, bits: a filter of 2**BITS bits over the tk of rows."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (BITS - 3), np.uint8)
        for b in batches:
            at = _bit(b.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(table, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        parts = table.reshape(-1, 1 << 12)
        full = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([parts[i].tobytes() for i in full], pa.binary())], ["chunk", "bits"])

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 12, np.uint8)
        for b in batches:
            for x in b.column(b.schema.get_field_index("bits")):
                total |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "bits"])

    return rows.select("tk").mapInArrow(mark, "chunk int, bits binary").groupBy("chunk").applyInArrow(join, "chunk int, bits binary")


def _open(ws: Workspace, members: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labelled, groups, open): members with their component; the leading class per shingle and component; the shingles of several components with the leader of all."""
    if links is None:
        m = members.withColumn("comp", F.col("b"))
    else:
        comps = ws.write(components(ws, links), "components")
        m = members.join(comps.select(F.col("node").alias("b"), "comp"), "b", "left").withColumn("comp", F.coalesce("comp", "b"))
    m = ws.write(m.select("a", "b", "size", "pos", "comp"), "members")
    groups = ws.write(m.groupBy("a", "comp").agg(F.min(F.struct("pos", "size", "b")).alias("r")), "groups")
    first = groups.groupBy("a").agg(F.min(F.struct("r", "comp")).alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    return m, groups, ws.write(first.select("a", F.col("f.comp").alias("lo"), F.col("f.r.b").alias("x"), F.col("f.r.size").alias("sx")), "open")


def _remaining(ws: Workspace, v: _Verifier, members: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: the pairs of members of one posting in different components that the length, positional and overlap bounds leave.

    Postings of the same members (a passage has one for each of its shingles) are one,
    at the first place. Small ones are paired by a join; in others members meet block
    against block, where the bounds apply, so what leaves a task may link.
    """
    m = ws.write(members, "left")
    same = m.groupBy("a").agg(F.count("*").alias("n"), F.sum(F.xxhash64("b").cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64(F.lit(3), "b").cast("decimal(38,0)")).alias("h2"))
    same = same.select("a", "n", F.xxhash64("n", "h1", "h2").alias("g"))
    m = m.join(same, "a").groupBy("g", "b").agg(F.min("n").alias("n"), F.min("pos").alias("pos"), F.min("size").alias("size"), F.min("comp").alias("comp"))
    m = ws.write(m, "postings")
    few = m.where(F.col("n") <= PAIRED)
    x, y = (few.select("g", F.col("b").alias(k), F.col("size").alias("s" + k), F.col("pos").alias("p" + k), F.col("comp").alias("c" + k)) for k in "xy")
    over = "least(sx - px, sy - py)"
    pairs = x.join(y, "g").where(f"cx < cy and {den} * least(sx, sy) >= {num} * greatest(sx, sy) and ({num + den}) * ({over}) >= {num} * (sx + sy)").select(F.col("x").alias("a"), F.col("y").alias("b"))
    many = m.where(F.col("n") > PAIRED)
    if many.isEmpty():
        return pairs
    texts = v.texts(many.select(F.col("b").alias("a"), "b"))
    n = v.n

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.minimum(np.bincount((shingles(t, n) >> np.uint64(56)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes() for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["b", "sketch"])

    sketches = ws.write(texts.select("c", "text").mapInArrow(sketch, "b long, sketch binary"), "sketches")
    many = many.join(sketches, "b").withColumn("blocks", F.ceil(F.col("n") / MEMBERS).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("g", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"), "own", "b", "size", "pos", "comp", "sketch")

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: dict[str, list] = {c: [] for c in ("own", "b", "size", "pos", "comp", "sketch")}
        for x in batches:
            for c, held in cols.items():
                held += x.column(x.schema.get_field_index(c)).to_pylist()
        own, b, size, pos, comp = (np.array(cols[c], np.int64) for c in ("own", "b", "size", "pos", "comp"))
        marks = np.frombuffer(b"".join(cols["sketch"]), np.uint8).reshape(len(b), BUCKETS).astype(np.int32)
        marks[marks == 255] = 1 << 20
        p, q = key[1].as_py(), key[2].as_py()
        right = np.flatnonzero(own == q)
        right = right[np.argsort(size[right], kind="stable")]
        for i in np.flatnonzero(own == p):
            lo, hi = np.searchsorted(size[right], [-(-size[i] * num // den), size[i] * den // num + 1])  # the length filter
            j = right[lo:hi]
            need = -(-(size[i] + size[j]) * num // (num + den))
            ok = (comp[j] != comp[i]) & (np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need)
            if p == q:
                ok &= b[j] > b[i]
            j, need = j[ok], need[ok]
            j = j[np.minimum(marks[i], marks[j]).sum(1) >= need]
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), b[i])), pa.array(b[j])], ["a", "b"])

    return pairs.unionByName(many.groupBy("g", "p", "q").applyInArrow(meet, "a long, b long"))


def link(docs: DataFrame, n: int = 5, num: int = 3, den: int = 4) -> tuple[DataFrame, DataFrame]:
    """(sets, labels): sets has doc_id, tk, c, size of every row; labels has c, component (least doc_id).

    Two classes link when overlap / union >= num / den.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "ngram-join")
    docs = docs.select("doc_id", "text")
    chars = docs.agg(F.sum(F.octet_length(F.col("text")))).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-int(chars) // (CHARS_PER_SHINGLE * TOKENS_PER_SHARD)))
    first = ws.write(_count(_deal_all(docs, shards, n)), "sets", clean=True)
    sets = first.where("kind = 0").select("doc_id", "tk", "c", "size")
    found = _candidates(_deal_prefix(first.where("kind = 1").select("block", "blob"), shards, num, den), num, den)
    found = ws.write(found, "candidates", clean=True)
    members = found.where("kind = 1").select("a", "b", "size", "pos")
    v = _Verifier(ws, docs, sets, n, num, den)
    v.check(found.where("kind = 0").select("a", "b"))
    for _ in range(STAR_ROUNDS):
        labelled, groups, open_ = _open(ws, members, v.links)
        rest = groups.join(open_, "a").where("comp <> lo").select("x", "sx", F.col("r.b").alias("y"), F.col("r.size").alias("sy"))
        if not v.check(rest.where(f"{den} * least(sx, sy) >= {num} * greatest(sx, sy)").select(F.col("x").alias("a"), F.col("y").alias("b"))):
            break
    else:
        labelled, groups, open_ = _open(ws, members, v.links)
    v.check(_remaining(ws, v, labelled.join(open_.select("a"), "a", "left_semi"), num, den))
    least = sets.where("doc_id is not null and size > 0").groupBy("c").agg(F.min("doc_id").alias("rep"))
    if v.links is None:
        return sets, least.select("c", F.col("rep").alias("component"))
    comps = ws.write(components(ws, v.links), "components")
    j = least.join(comps.select(F.col("node").alias("c"), "comp"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    j = ws.write(j, "classes")
    low = j.groupBy("comp").agg(F.min("rep").alias("component"))
    return sets, ws.write(j.join(low, "comp").select("c", "component"), "labels")


def _labelled(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """sets with the component of their class. Classes of many rows (``HOT``, or a 10,000th of all, so at most 10,000) go by a broadcast."""
    n = sets.groupBy("c").agg(F.count("*").alias("n"))
    most = max(HOT, sets.count() // HOT_KEYS)
    hot = labels.join(n.where(F.col("n") > most).select("c"), "c", "left_semi").select("c", F.col("component").alias("hot"))
    rows = sets.join(F.broadcast(hot), "c", "left").withColumn("k", F.when(F.col("hot").isNull(), F.col("c")).otherwise(F.xxhash64("c", "doc_id", "tk")))
    rare = labels.select(F.col("c").alias("k"), "component")
    return rows.join(rare, "k", "left").withColumn("component", F.coalesce("hot", "component")).drop("k", "hot")


def digest(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    sets, labels = link(docs, **parameters)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return _labelled(sets, labels).select("doc_id", F.col("size").cast("long").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id (smallest text key among repeated ids).

    Empty texts and null ids are linked with nothing and all stay.
    """
    sets, labels = link(docs, **parameters)
    rows = _labelled(sets, labels).where("doc_id is not null and component is not null and doc_id <> component")
    gone = rows.select(F.col("doc_id").alias("__doc"), F.col("tk").alias("__tk")).distinct()
    return keyed(docs).join(gone, ["__doc", "__tk"], "left_anti").select("__row.*")
