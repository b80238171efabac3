"""Toxicity by weak supervision.

1. A bounded sample of labelled rows (``max_train``, smallest hashes of doc_id
   first, fold 0 of five held out) supplies lexicon voters: word stems whose share
   among toxic rows is far above that among clean rows. This is all that labels are
   used for. Pattern voters (shouting, marks, symbols, repetition, few words, no
   stem at all) vote beside them, for either side.
2. A generative label model takes only the votes: expectation maximisation finds
   each voter's accuracy and the class balance; residual correlations between
   voters, given the posterior, let voters that repeat one another share a voice.
3. A linear classifier over stems is chosen, scaled and trained by the posteriors.
4. Every whole text is scored in one narrow pass; labels, lang, source and
   doc_id are no inputs.

Only the model (a weight for each of the sample's stems that tell) is sent to the executors.

Defined results: null or empty texts get the score of a text without features;
null doc_ids are not held out and never train; without usable labels, or without any
stem that tells, the score is the prior 0; a score of exactly 0.5 is toxic; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, give_back

_WORD = re.compile(r"[^\W\d_]+")
_SIGN = re.compile(r"[^\w\s]")
STEMS = (4, 5, 6)
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(text: str) -> set[str]:
    """Distinct lower-case words (whole, marked by a trailing dot) and their stems."""
    out: set[str] = set()
    for w in set(_WORD.findall(text.lower())):
        out.add(w + ".")
        out.update(w[:k] for k in STEMS if len(w) >= k)
    return out


def patterns(text: str) -> tuple[int, ...]:
    """Votes of the pattern voters on one text: 1 for toxic, 0 for clean, -1 to abstain."""
    n = max(len(text), 1)
    words = text.split()
    shout = sum(map(str.isupper, text)) > 0.6 * n
    marks = any(x in text for x in ("!!", "?!", "!?"))
    signs = len(_SIGN.findall(text)) > 0.3 * n
    same = len(words) > 20 and len(set(words)) < 0.1 * len(words)
    return (1 if shout else -1, 1 if marks else -1, *(0 if x else -1 for x in (signs, same, len(words) < 5)))


@dataclass
class LabelModel:
    """P(toxic | votes) from voters that say 1, 0 or nothing (-1). No label enters it.

    Where one voter alone speaks, votes cannot tell how right it is; there it is held
    to be right in ``prior`` of all cases.
    """

    rounds: int = 60
    strength: float = 1.0
    prior: float = 0.95

    def fit(self, votes: np.ndarray) -> np.ndarray:
        """Posterior of each row; sets ``accuracy``, ``correlation`` and ``balance``."""
        x1, x0 = (votes == 1).astype(np.float32), (votes == 0).astype(np.float32)
        m = votes.shape[1]
        n1, n0, all1, all0 = x1.sum(1), x0.sum(1), x1.sum(0), x0.sum(0)
        alone = n1 + n0 == 1
        alone1, alone0 = (alone @ x1), (alone @ x0)
        p = (n1 + 0.025) / (n1 + n0 + 0.5)  # a vote of all voters, with a low prior where none speaks
        alike = np.zeros((m, m), np.float32)
        shared = np.ones_like(x1)
        for r in range(self.rounds):
            self.balance = float(np.clip(p.mean(), 1e-3, 1 - 1e-3))
            # chance of each vote given the class, smoothed
            t, c = p.sum() + 2, (1 - p).sum() + 2
            right1, right0 = np.where(alone, 0, p) @ x1 + self.prior * alone1, np.where(alone, 0, 1 - p) @ x0 + self.prior * alone0
            a1, b1 = (right1 + 1e-2) / t, (all1 - right1 + 1e-2) / c
            a0, b0 = (all0 - right0 + 1e-2) / t, (right0 + 1e-2) / c
            log1, log0 = np.log(a1 / b1), np.log(a0 / b0)
            if r % 10 == 0:
                alike = self._alike(x1 - x0, p).astype(np.float32)
                shared = 1 / (1 + (x1 + x0) @ alike)  # voters of a row that repeat one another share one voice
            odds = math.log(self.balance / (1 - self.balance)) + (x1 * shared) @ log1 + (x0 * shared) @ log0
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        self.correlation = alike
        self.accuracy = ((p @ x1) + ((1 - p) @ x0)) / np.maximum(all1 + all0, 1)
        return p

    def _alike(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Positive residual correlations of the voters, given the posterior."""
        given1 = (p @ x) / (p.sum() + 1e-9)
        given0 = ((1 - p) @ x) / ((1 - p).sum() + 1e-9)
        res = x - np.outer(p, given1) - np.outer(1 - p, given0)
        sd = np.sqrt((res**2).sum(0)) + 1e-9
        corr = (res.T @ res) / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        return self.strength * np.where(corr > 0.2, corr, 0)


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """A function from text to score; a word's features are looked up once and remembered."""
        weights, bias, seen = self.weights, self.bias, {}

        def of(word: str) -> frozenset:
            f = [word + ".", *(word[:k] for k in STEMS if len(word) >= k)]
            got = frozenset(x for x in f if x in weights)
            if len(seen) > 100_000:
                seen.clear()
            seen[word] = got
            return got

        none: frozenset = frozenset()

        def score(text: str | None) -> float:
            hit: set[str] = set()
            for w in set(_WORD.findall(text.lower())) if text else ():
                f = seen.get(w)
                if f is None:
                    f = of(w)
                if f is not none and f:
                    hit |= f
            z = bias + sum(sorted(weights[x] for x in hit))
            return 1 / (1 + math.exp(-z)) if z > -30 else 0.0

        return score


SLICE = 256  # rows whose stems are held at once
LEAST = 3  # rows that a stem must stand in to count


@dataclass
class Sample:
    """Labelled rows as stem numbers: stem ``col[i]`` (a place in ``names``) stands in row ``row[i]``."""

    toxic: np.ndarray
    said: np.ndarray
    row: np.ndarray
    col: np.ndarray
    names: list[str]


def sample(docs: DataFrame, labels: DataFrame, max_train: int) -> Sample | None:
    """At most ``max_train`` labelled rows outside the held-out fold. Texts stay on the executors: the driver gets stems of at least ``LEAST`` rows and their numbers."""
    ws = Workspace(docs.sparkSession, "toxicity")
    pick = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(max_train)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(pick), "doc_id")
    rows = rows.select("toxic", "text", F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("t"))
    schema = "toxic int, h long, doc_id long, t long, said array<int>, stems array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(z, SLICE) for whole in batches for z in range(0, whole.num_rows, SLICE)):
            texts = [t or "" for t in b.column(1).to_pylist()]
            said, stems = [list(patterns(t)) for t in texts], [sorted(features(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), pa.array(said, pa.list_(pa.int32())), pa.array(stems, pa.list_(pa.string()))], ["toxic", "h", "doc_id", "t", "said", "stems"])
        give_back()

    rows = ws.write(rows.mapInArrow(run, schema).orderBy("h", "doc_id", "t").limit(max_train), "rows")
    often = rows.select(F.explode("stems").alias("s")).groupBy("s").count().where(F.col("count") >= LEAST)
    names = sorted(r.s for r in often.select("s").collect())
    number = docs.sparkSession.sparkContext.broadcast({s: i for i, s in enumerate(names)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = number.value
        for b in batches:
            ids = [[of[s] for s in x if s in of] for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["toxic", "said", "ids"])

    got = rows.select("toxic", "said", "stems").mapInArrow(count, "toxic int, said array<int>, ids array<int>").toArrow()
    ws.drop(rows)
    if not len(got):
        return None
    ids = got.column("ids").combine_chunks()
    row = np.repeat(np.arange(len(got)), np.diff(ids.offsets.to_numpy()))
    return Sample(got.column("toxic").to_numpy().astype(np.int64), np.array(got.column("said").to_pylist(), np.int8), row, ids.flatten().to_numpy(), names)


def train(docs: DataFrame, labels: DataFrame, max_train: int = 6000) -> ToxicityModel:
    """Fit on at most ``max_train`` labelled rows outside the held-out fold."""
    return fit(sample(docs, labels, max_train))


def fit(s: Sample | None) -> ToxicityModel:
    """Voters from the labelled rows, posteriors from the votes, the classifier from the posteriors."""
    if s is None or not s.toxic.any():
        return ToxicityModel({}, -30.0)
    row, col, y, n, m = s.row, s.col, s.toxic, len(s.toxic), len(s.names)
    pos = np.bincount(col[y[row] == 1], minlength=m)
    neg = np.bincount(col[y[row] == 0], minlength=m)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    # Lexicon voters: stems all but confined to toxic rows. Of so many stems some meet only toxic
    # rows by chance: a voter needs more rows than chance would give any stem.
    odds = ((pos + 0.1) / (n1 + 1)) / ((neg + 0.1) / (n0 + 1))
    least = math.log(0.5 / max(m, 1)) / math.log(min(max(n1 / (n1 + n0), 0.01), 0.5))
    lexicon = np.flatnonzero((pos >= max(float(LEAST), least)) & (odds >= 100) & (pos >= 50 * neg))
    if not len(lexicon):
        return ToxicityModel({}, -30.0)
    place = np.full(m, -1)
    place[lexicon] = np.arange(len(lexicon))
    hit = place[col] >= 0
    votes = np.full((n, len(lexicon) + s.said.shape[1] + 1), -1, np.int8)
    votes[row[hit], place[col[hit]]] = 1
    votes[:, len(lexicon) : -1] = s.said
    votes[:, -1] = np.where(np.bincount(row[hit], minlength=n) > 0, -1, 0)
    return _linear(row, col, LabelModel().fit(votes), s.names, min(least, 5.0))


def _linear(row: np.ndarray, col: np.ndarray, target: np.ndarray, names: list[str], least: float) -> ToxicityModel:
    """Logistic regression on the posteriors alone: presence features, L2, Nesterov steps; then the scale is set.

    A long text holds many stems by chance, so one enters only if toxic rows are
    twice as common among those that hold it, and then with their share, squared.
    """
    n, m = len(target), len(names)
    pos, all_ = np.bincount(col, weights=target[row], minlength=m), np.bincount(col, minlength=m)
    use = np.flatnonzero((all_ >= least) & (pos >= 2 * target.mean() * all_))
    place = np.full(m, -1)
    place[use] = np.arange(len(use))
    ok = place[col] >= 0
    row, col, m = row[ok], place[col[ok]], len(use)
    scale = 0.02 + (pos[use] / (4 * all_[use] - 3 * pos[use])) ** 2
    w, v, b, vb = np.zeros(m), np.zeros(m), -2.0, 0.0
    step, lam = 1.0, 1e-5
    for _ in range(300):
        ww, bb = w + 0.9 * v, b + 0.9 * vb
        z = np.bincount(row, weights=(ww * scale)[col], minlength=n) + bb
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        gw = np.bincount(col, weights=g[row], minlength=m) * scale / n + lam * ww
        v, vb = 0.9 * v - step * gw, 0.9 * vb - step * g.mean()
        w, b = w + v, b + vb
    final = w * scale
    z = np.bincount(row, weights=final[col], minlength=n) + b
    hard = target >= 0.5
    if hard.any() and not hard.all():
        # The cut of the fewest errors on the training posteriors goes to 0.5, in the middle of the widest such gap.
        order = np.argsort(z, kind="stable")
        zs, hs = z[order], hard[order]
        wrong = np.concatenate([[0], np.cumsum(hs)]) + np.concatenate([[0], np.cumsum(~hs[::-1])])[::-1]
        inner = np.arange(1, n)
        best = inner[wrong[1:n] == wrong[1:n].min()]
        k = int(best[np.argmax(zs[best] - zs[best - 1])])
        cut, width = (zs[k] + zs[k - 1]) / 2, max(zs[k] - zs[k - 1], 0.2)
        sharp = max(1.0, 2.0 / width)
        final, b = final * sharp, (b - cut) * sharp
    keep = np.abs(final) > 1e-4
    return ToxicityModel({names[f]: float(x) for f, x in zip(use[keep], final[keep])}, float(b))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.scorer()
        for b in batches:
            s = [f(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])
        del f
        give_back()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs without the rows that the model calls toxic; all columns stay."""
    where = docs.columns.index("text")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.scorer()
        for b in batches:
            yield b.filter(pa.array([f(x) < 0.5 for x in b.column(where).to_pylist()], pa.bool_()))
        del f
        give_back()

    return docs.mapInArrow(run, schema)
