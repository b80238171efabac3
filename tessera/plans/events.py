"""The whole run on events: dialogues to event segments, to a typed graph, to expanded retrieval, answers and ratings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.callstore import CallStore
from tessera.functions.providers import Provider
from tessera.operators import chunking, graph, joins, vectors
from tessera.operators.ordering import numbered
from tessera.operators.similarity import nearest_within
from tessera.plans.answer import answer_and_rate, boundaries, contexts, scores_by_category
from tessera.plans.expand import expand_text
from tessera.plans.stages import Stages, checksum
from tessera.plans.storage import scratch


@dataclass
class Models:
    """The providers of a run, one for each kind of call."""

    segmenter: Provider
    sufficiency: Provider
    relevance: Provider
    answerer: Provider
    judge: Provider


def _vectors(rows: DataFrame, ids: list[str], text: str) -> DataFrame:
    return vectors.dense(vectors.hash_embedding(rows, ids, text), ids)


def run(turns: DataFrame, path: str, models: Models, k: int = 3, text_over: float = 0.7, sentence_over: float = 0.8, least_sentence: int = 30, prompt: str = "situation", version: str = "") -> dict[str, DataFrame]:
    """Every stage's table by its name; those that are whole under ``path`` are read, the others made.

    turns: conv_id, session_ord, turn_ord, speaker, text (``dialogue.from_table``).
    Stages: lines, boundaries, segments, tokens (the calls and tokens of the
    segmentation), nodes, questions, sentences, edges, anchors, found, rated, summary.
    Nodes and questions have numbers of their own over all dialogues. Every response
    goes to ``path/calls``, so a stage that is made again asks nothing that was
    answered. Other models are another run: say so by ``version`` (or another path).
    """
    spark = turns.sparkSession
    stages = Stages(spark, path)
    store = CallStore(spark, f"{path}/calls-{version}" if version else f"{path}/calls")
    keep = stages.keep
    with scratch():
        line = F.concat(F.coalesce("speaker", F.lit("")), F.lit(":"), X.strip(F.coalesce("text", F.lit(""))))
        lines = keep("lines", lambda: turns.select("conv_id", "turn_ord", line.alias("line")), input=checksum(turns.select("conv_id", "turn_ord", "speaker", "text")))
        asked = lambda: boundaries(chunking.numbered_lines(lines, ["conv_id"], "turn_ord", "line"), models.segmenter, prompt, store=store, stage="boundaries")
        marks = keep("boundaries", lambda: asked().select("conv_id", F.col("boundary").cast("long").alias("turn_ord"), "reason"), "lines", prompt=prompt, version=version)
        segments = keep("segments", lambda: chunking.cut(lines, marks, ["conv_id"], "turn_ord", "line"), "lines", "boundaries")
        tokens = keep("tokens", lambda: store.ledger({"boundaries": "call_id"}), "boundaries")
        nodes = keep("nodes", lambda: numbered(segments, [], ["conv_id", "segment"]).select("conv_id", "segment", F.col("rn").alias("node"), "chunk", F.lit(None).cast("string").alias("timestamp")), "segments")
        found = lambda: joins.questions(turns, spread=True).withColumnRenamed("answer", "truth").withColumn("label", F.col("conv_id") % 5)
        questions = keep("questions", lambda: numbered(found(), [], ["conv_id", "turn_ord"]).select("conv_id", F.col("turn_ord").alias("turn"), F.col("rn").alias("q_id"), "question", "truth", "label"), "lines")
        split = lambda: numbered(X.graph_sentences(nodes, ["conv_id", "node"], "chunk", least_sentence), [], ["node", "line_idx", "piece_idx"])
        sentences = keep("sentences", lambda: split().select("conv_id", "node", F.col("rn").alias("sentence_id"), "sentence"), "nodes", least=least_sentence)

        def edges() -> DataFrame:
            said = _vectors(sentences, ["conv_id", "node", "sentence_id"], "sentence").withColumnRenamed("sentence_id", "sentence")
            return graph.typed_graph(_vectors(nodes, ["conv_id", "node"], "chunk"), said, text_over, sentence_over, ["conv_id"])

        typed = keep("edges", edges, "nodes", "sentences", over=[text_over, sentence_over])
        anchors = keep("anchors", lambda: nearest_within(_vectors(questions, ["conv_id", "q_id"], "question"), _vectors(nodes, ["conv_id", "node"], "chunk"), ["conv_id"], "q_id", "node", "v", k), "questions", "nodes", k=k)

        def expanded() -> DataFrame:
            sym = graph.symmetric(typed, [])
            return expand_text(questions.select("q_id", "question"), anchors.select("q_id", "node", "rk"), nodes.select("node", "chunk", "timestamp"), sym, models.sufficiency, models.relevance, store=store)[0]

        docs = keep("found", expanded, "anchors", "edges", version=version)
        context = lambda: contexts(questions, docs.withColumn("__o", F.struct("round", "ord")), ["q_id"], "__o", "doc")
        rated = keep("rated", lambda: answer_and_rate(context(), models.answerer, models.judge, store=store), "questions", "found", version=version)
        summary = keep("summary", lambda: scores_by_category(rated), "rated")
    return {"lines": lines, "boundaries": marks, "segments": segments, "tokens": tokens, "nodes": nodes, "questions": questions, "sentences": sentences, "edges": typed, "anchors": anchors, "found": docs, "rated": rated, "summary": summary}
