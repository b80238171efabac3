"""Model calls: chat and embedding providers, with deterministic stand-ins.

A provider is a picklable object with ``reply(prompt) -> str``. Calls run in
``mapInArrow`` with a bounded thread pool per task; a failed call gives status
``error`` and no response, never a failed job. Prompts are keyed by hash and every
response is written to a call store (callstore.py) before anything is built on it.
"""

from __future__ import annotations

import json
import math
import os
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions.callstore import CallStore
from tessera.functions.text import TOKENS_PER_CHAR, estimated_tokens, strip
from tessera.operators.chunking import fold
from tessera.plans.storage import bucketed, tasks

#: Our own wording of the pipeline's prompts; {} fields are filled from columns.
PROMPTS = {
    "boundaries": "Mark where the topic of this dialogue changes. Reply as JSON: topic_boundaries, a list of boundary_index and reason.\n{context}",
    "situation": "Mark where the situation changes in goal, activity, people, cause, time or place. Reply as JSON: topic_boundaries, a list of boundary_index and reason.\n{context}",
    "predict": "Write the most likely next turn of this dialogue.\n{context}",
    "summary": "Summarise the passage in one sentence. Reply as JSON: summary.\n{context}",
    "relevance": "Rate from 1 to 10 how far each passage helps to answer the question. Reply as JSON: results, a list of doc_id and score.\nQuestion: {question}\n{context}",
    "sufficiency": "Do the passages answer the question? 0 no, 1 in part, 2 fully. Reply as JSON: result.\nQuestion: {question}\n{context}",
    "answer": "Answer from the passages, briefly and exactly. Reply as JSON: answer.\nQuestion: {question}\n{context}",
    "answer_abstract": "Answer from the passages, drawing conclusions where needed. Reply as JSON: answer.\nQuestion: {question}\n{context}",
    "filter": "Copy the sentences that bear on the question, word for word. Reply as JSON: filtered_text, a list.\nQuestion: {question}\n{context}",
    "judge_0_1": "Is the answer right? 1 yes, 0 no. Reply as JSON: rating.\nQuestion: {question}\nTruth: {truth}\nAnswer: {answer}",
    "judge_0_100": "Rate the answer against the truth from 1 to 100. Reply as JSON: rating.\nQuestion: {question}\nTruth: {truth}\nAnswer: {answer}",
}


class Provider(Protocol):
    def reply(self, prompt: str) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class Scripted:
    """A stand-in: a function of the prompt."""

    function: Callable[[str], str]

    def reply(self, prompt: str) -> str:
        return self.function(prompt)


@dataclass
class Quote:
    """A baseline without a model: answers with the first line of the passages. The question must be one line."""

    def reply(self, prompt: str) -> str:
        context = prompt.split("\nQuestion: ", 1)[1].partition("\n")[2]
        return json.dumps({"answer": next((x for x in context.split("\n") if x.strip()), "")})


@dataclass
class Overlap:
    """A baseline judge: 1 plus 99 times the share of the truth's words (of a to z) that the answer has; no rating without such words."""

    def reply(self, prompt: str) -> str:
        truth, answer = prompt.split("\nTruth: ", 1)[1].split("\nAnswer: ", 1)
        want, said = (set(re.findall("[a-z]+", x.lower())) for x in (truth, answer))
        return json.dumps({"rating": 1 + 99 * len(want & said) // len(want)} if want else {})


@dataclass
class ScriptedEmbedder:
    """A stand-in: a function of one text."""

    function: Callable[[str], list[float]]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.function(t) for t in texts]


@dataclass
class _Endpoint:
    """An HTTP endpoint (OpenAI-style bodies); requests are made on the executor, the key is read there from the environment.

    A request that fails is made again, ``retries`` times, after waits that double.
    """

    url: str
    model: str
    key_variable: str = "CHAT_API_KEY"
    timeout: float = 60.0
    retries: int = 2
    wait: float = 1.0

    def post(self, body: dict) -> dict:
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"}
        for k in range(self.retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps({"model": self.model, **body}).encode(), head), timeout=self.timeout) as r:
                    return json.load(r)
            except (OSError, ValueError):
                if k == self.retries:
                    raise
                time.sleep(self.wait * 2**k)
        raise AssertionError


@dataclass
class Remote(_Endpoint):
    """Chat completions; without a temperature the endpoint's default holds."""

    temperature: float | None = 0.0

    def reply(self, prompt: str) -> str:
        body = {"messages": [{"role": "user", "content": prompt}]} | ({} if self.temperature is None else {"temperature": self.temperature})
        return self.post(body)["choices"][0]["message"]["content"]


@dataclass
class RemoteEmbedder(_Endpoint):
    """Embeddings of a list of texts, in its order."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [d["embedding"] for d in sorted(self.post({"input": texts})["data"], key=lambda d: d["index"])]


CALLS = "call_id string, response string, status string, input_tokens long, output_tokens long"
HELD = 256  # prompts that a task holds as Python texts
VECTORS = "text_id string, vec array<float>, status string, input_tokens long, output_tokens long"


def _answers(batches: Iterator[pa.RecordBatch], provider: Provider, workers: int) -> Iterator[pa.RecordBatch]:
    """Rows of call_id, response, status, input_tokens for those of call_id, __p, input_tokens. No more than HELD prompts are Python texts at once."""

    def one(p: str) -> tuple[str | None, str]:
        try:
            return provider.reply(p), "ok"
        except Exception:  # a failed call is a result, not a failed job
            return None, "error"

    with ThreadPoolExecutor(workers) as pool:
        for b in batches:
            for part in (b.slice(z, HELD) for z in range(0, b.num_rows, HELD)):
                got = list(pool.map(one, part.column("__p").to_pylist()))
                response, status = (pa.array([g[i] for g in got], pa.string()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column("call_id"), response, status, part.column("input_tokens")], ["call_id", "response", "status", "input_tokens"])


def call(rows: DataFrame, provider: Provider, prompt: str | Column = "prompt", workers: int = 8, cache: DataFrame | None = None, store: CallStore | None = None, stage: str = "calls", waves: int = 1, hold: bool = True) -> DataFrame:
    """rows with call_id, response, status: one call per distinct prompt that neither ``store`` nor ``cache`` (call_id, response) holds.

    The calls are made here, in a job that writes them to the store's ``stage``; the
    result reads them from there. Without a store the answers go to one of their own.
    A null prompt is not asked and has status error. A prompt that is given as an
    expression is a column ``prompt`` of the result.

    The rows are evaluated once and written in buckets by prompt, so prompts are dealt
    once and answers come to the rows. Without ``hold`` the rows are not written: for
    rows that are cheap to evaluate twice.
    """
    text = F.col(prompt) if isinstance(prompt, str) else prompt
    keyed = rows.withColumn("call_id", F.sha2(text, 256))
    if hold:
        keyed = bucketed(keyed, "prompts", "call_id", buckets=tasks(rows.sparkSession), codec="zstd")
    todo = keyed.where("call_id is not null").select("call_id", text.alias("__p"))
    if cache is not None:
        todo = todo.join(cache.select("call_id"), "call_id", "left_anti")

    def ask(missing: DataFrame) -> DataFrame:
        sized = missing.withColumn("input_tokens", estimated_tokens(F.col("__p")).cast("long"))
        made = sized.select("call_id", "__p", "input_tokens").mapInArrow(lambda batches: _answers(batches, provider, workers), "call_id string, response string, status string, input_tokens long")
        return made.withColumn("output_tokens", F.coalesce(estimated_tokens(F.col("response")), F.lit(0)))

    store = store or CallStore(rows.sparkSession)
    made = store.extend(todo, "call_id", ask, stage, CALLS, waves).select("call_id", "response", "status")
    if cache is not None:
        kept = cache.select("call_id", "response", F.lit("ok").alias("status"))
        made = kept.unionByName(made.join(kept, "call_id", "left_anti"))
    out = keyed.join(made, "call_id", "left").withColumn("status", F.coalesce("status", F.lit("error")))
    return out if isinstance(prompt, str) else out.withColumn("prompt", text)


def embed(rows: DataFrame, embedder: Embedder, text: str, dim: int, budget: int = 8000, store: CallStore | None = None, stage: str = "embeddings") -> DataFrame:
    """rows with vec (array<float>) and embed_status: one vector for each distinct stripped text, asked for in batches.

    Blank and null texts are zero vectors and are not asked for. A batch holds texts of
    at most ``budget`` estimated tokens (an over-long one stands alone); one that fails,
    or whose answer has another shape, gives status error and no vectors. Vectors are
    written to the store and read from there, like answers.
    """
    stripped = strip(F.coalesce(F.col(text), F.lit("")))
    keyed = rows.withColumn("__k", F.sha2(stripped, 256))
    todo = keyed.where(F.length(stripped) > 0).select(F.col("__k").alias("text_id"), stripped.alias("__t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            sizes = [math.ceil(len(t) * TOKENS_PER_CHAR) for t in texts]
            number = fold(sizes, budget)
            vecs, status = [], []
            for _, part in groupby(zip(number, texts), key=lambda x: x[0]):
                own = [t for _, t in part]
                try:
                    got = embedder.embed(own)
                    if len(got) != len(own) or any(len(v) != dim for v in got):
                        raise ValueError("another number or length of vectors than asked for")
                    vecs += got
                    status += ["ok"] * len(own)
                except Exception:  # a failed call is a result, not a failed job
                    vecs += [None] * len(own)
                    status += ["error"] * len(own)
            arrays = [pa.array(keys, pa.string()), pa.array(vecs, pa.list_(pa.float32())), pa.array(status, pa.string()), pa.array(sizes, pa.int64()), pa.array([0] * len(sizes), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["text_id", "vec", "status", "input_tokens", "output_tokens"])

    store = store or CallStore(rows.sparkSession)
    made = store.extend(todo, "text_id", lambda missing: missing.mapInArrow(run, VECTORS), stage, VECTORS)
    made = made.select(F.col("text_id").alias("__k"), "vec", F.col("status").alias("embed_status"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    out = keyed.join(made, "__k", "left").drop("__k")
    blank = F.length(stripped) == 0
    return out.withColumn("vec", F.when(blank, zero).otherwise(F.col("vec"))).withColumn("embed_status", F.when(blank, "blank").otherwise(F.col("embed_status")))


def report(calls: DataFrame, tokens: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """Totals of a call table (call_id, prompt, response): calls, input and output tokens, average per call. A prompt is called once."""
    made = calls.dropDuplicates(["call_id"])
    t = made.agg(F.count("*").alias("calls"), F.coalesce(F.sum(tokens(F.col("prompt"))), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum(tokens(F.col("response"))), F.lit(0)).alias("output_tokens"))
    return t.withColumn("average", (F.col("input_tokens") + F.col("output_tokens")) / F.greatest(F.lit(1), "calls"))


def _lengths(tokenizer, texts: pd.Series) -> pd.Series:
    """Tokens of each text. One is encoded at a time: an encoding takes many times the memory of its text."""
    return pd.Series([len(tokenizer.encode(t, add_special_tokens=False)) for t in texts.fillna("")], dtype="int64")


def exact_tokens(vocabulary: str, fallback: str | None = None) -> Callable[[Column], Column]:
    """Exact token counts by a tokenizer file (a path that executors share); ``fallback`` is taken where there is no such file."""
    path = vocabulary if fallback is None or os.path.exists(vocabulary) else fallback

    @pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        for s in texts:
            yield _lengths(tok, s)

    return count
