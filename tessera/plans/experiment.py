"""Whole runs over all conversations at once: every stage is a table with the conversation as a key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.providers import Provider
from tessera.operators import chunking, graph, joins, series, vectors
from tessera.plans.answer import answer_and_rate, contexts, predict, scores_by_category


def name() -> str:
    return uuid.uuid4().hex


def run(turns: DataFrame, path: str, answerer: Provider, judge: Provider, rounds: int = 1, over: float = 0.5, k: int = 3) -> dict[str, DataFrame]:
    """Chunks, nodes, edges, retrieved, rated, each written under ``path`` and read back; summary by category.

    A stage's rows are dealt to files by conversation and sorted by it, so a file holds
    many whole conversations, and how many files there are does not grow with them.
    A stage reads what the one before has written, so a run that failed can go on from
    its last whole stage. A conversation without turns or questions has no rows.
    """
    spark = turns.sparkSession
    out: dict[str, DataFrame] = {}

    def keep(stage: str, rows: DataFrame) -> DataFrame:
        rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id").write.mode("overwrite").parquet(f"{path}/{stage}")
        fields = [f for f in rows.schema.fields if f.name != "conv_id"] + [rows.schema["conv_id"]]
        out[stage] = spark.read.schema(type(rows.schema)(fields)).parquet(f"{path}/{stage}")
        return out[stage]

    chunks = keep("chunks", chunking.turn_chunks(turns, rounds).select("conv_id", "session_ord", "block", "chunk"))
    vecs = vectors.hash_embedding(chunks, ["conv_id", "block"], "chunk")
    keep("nodes", chunks.select("conv_id", F.col("block").alias("node"), F.col("chunk").alias("content")))
    keep("edges", graph.simple_edges(vectors.sparse_pairs(vecs, "conv_id", "block"), ["conv_id"], over))
    questions = joins.questions(turns).withColumnRenamed("answer", "truth")
    q = vectors.hash_embedding(questions, ["conv_id", "turn_ord"], "question")
    top = vectors.top_k(vectors.sparse_scores(q, vecs, ["conv_id"], ["conv_id", "turn_ord", "block"]), ["conv_id", "turn_ord"], "block", k)
    found = keep("retrieved", top.join(chunks.drop("session_ord"), ["conv_id", "block"]))
    asked = contexts(questions.withColumn("label", F.col("conv_id") % 5), found, ["conv_id", "turn_ord"], "rk", "chunk")
    rated = keep("rated", answer_and_rate(asked, answerer, judge))
    out["summary"] = scores_by_category(rated)
    return out


def segment_by_prediction(lines: DataFrame, sentences: DataFrame, predictor: Provider) -> DataFrame:
    """conv_id, segment, chunk, n_lines: lines cut where what follows is least like what was predicted.

    lines: conv_id, turn, line. sentences: conv_id, turn, p, sentence. From the last
    sentences so far the next one is predicted; its mean similarity to the next three is a series
    whose valleys are boundaries, at the turn of the sentence after the valley.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "p")
    s = sentences.withColumn("i", F.row_number().over(w) - 1)
    said = predict(series.rolling(s, ["conv_id"], "i", "sentence"), predictor)
    sims = series.forward_similarity(s, vectors.hash_embedding(said, ["conv_id", "i"], "predicted"), vectors.hash_embedding(s, ["conv_id", "i"], "sentence"), ["conv_id"], "i")
    valley = series.valleys(sims, ["conv_id"], ["i"], "sim").select("conv_id", (F.col("i") + 1).alias("i"))
    marks = s.join(valley, ["conv_id", "i"], "left_semi").select("conv_id", "turn").distinct()
    return chunking.cut(lines, marks, ["conv_id"], "turn", "line")
