"""Bounded iterative expansion over the memory graph, for all questions at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.callstore import CallStore
from tessera.functions.providers import Provider
from tessera.functions.text import timed
from tessera.operators.chunking import numbered_lines
from tessera.operators.graph import unvisited_neighbors
from tessera.plans.answer import contexts, relevance, sufficient
from tessera.plans.storage import written


def expand(anchors: DataFrame, sym: DataFrame, judge: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], keep: int = 5, max_rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(docs, status). anchors: q_id, node, rk. sym: node, neighbor, weight.

    Each round: ``judge`` (docs -> q_id, verdict; 2 stops, null is an error), then
    the unvisited neighbours of the frontier (visited from now on, even if
    rejected), then ``score`` (q_id, node -> with score); those of at least ``keep``
    are appended and are the next frontier. docs: q_id, node, round, ord.
    """
    visited = []

    def reach(frontier: DataFrame, docs: DataFrame) -> DataFrame:
        seen = reduce(DataFrame.unionByName, visited, docs.select("q_id", "node"))
        visited.append(written(unvisited_neighbors(frontier, seen, sym, []), "visited"))
        return score(visited[-1]).where(F.col("score") >= keep).select("q_id", "node")

    return expand_by(anchors, judge, reach, max_rounds)


def expand_by(anchors: DataFrame, judge: Callable[[DataFrame], DataFrame], reach: Callable[[DataFrame, DataFrame], DataFrame], max_rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """``expand`` with any way from a frontier to what is appended: ``reach`` (frontier, docs -> q_id, node, none of them in docs), both of the questions that go on.

    A round's documents are written once and not again with those of the next.
    """
    spark = anchors.sparkSession
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        docs = written(anchors.select("q_id", "node", F.lit(0).alias("round"), F.col("rk").cast("bigint").alias("ord")), "docs")
        frontier = docs.select("q_id", "node")
        active = docs.select("q_id").distinct()
        done = None
        for r in range(1, max_rounds + 1):
            verdict = written(active.join(judge(docs.join(active, "q_id", "left_semi")), "q_id", "left"), "verdicts")
            stop = verdict.where("verdict is null or verdict = 2").select("q_id", F.when(F.col("verdict").isNull(), "error").otherwise("sufficient").alias("status"), F.lit(r).alias("round"))
            active = verdict.where("verdict <> 2").select("q_id")
            found = reach(frontier.join(active, "q_id", "left_semi"), docs.join(active, "q_id", "left_semi"))
            new = written(found.select("q_id", "node", F.lit(r).alias("round"), F.col("node").cast("bigint").alias("ord")), "docs")
            out = active.join(new.select("q_id").distinct(), "q_id", "left_anti").select("q_id", F.lit("no_more_nodes").alias("status"), F.lit(r).alias("round"))
            ended = stop.unionByName(out)
            done = ended if done is None else done.unionByName(ended)
            docs = docs.unionByName(new)
            frontier = new.select("q_id", "node")
            active = written(active.join(out, "q_id", "left_anti"), "active")
            if active.isEmpty():
                break
        status = done.unionByName(active.select("q_id", F.lit("max_iter_reached").alias("status"), F.lit(max_rounds).alias("round")))
        return docs, written(status, "status")
    finally:
        spark.conf.set(key, before)


def expand_text(questions: DataFrame, anchors: DataFrame, nodes: DataFrame, sym: DataFrame, judge: Provider, scorer: Provider, keep: int = 5, max_rounds: int = 3, store: CallStore | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs with their texts, status) of ``expand`` with both judgements by providers.

    questions: q_id, question; nodes: node, chunk, timestamp. A document is
    ``time:...,content:...``; nodes without text are never documents.
    """
    nodes = nodes.where(F.length("chunk") > 0).select("node", "chunk", timed(F.col("timestamp"), F.col("chunk"), ",").alias("doc"))
    texts = nodes.select("node", "doc")
    store = store or CallStore(questions.sparkSession)

    def verdicts(docs: DataFrame) -> DataFrame:
        held = docs.join(texts, "node").withColumn("__o", F.struct("round", "ord"))
        asked = contexts(questions.join(docs.select("q_id").distinct(), "q_id", "left_semi"), held, ["q_id"], "__o", "doc")
        return sufficient(asked, judge, store=store, stage="sufficiency").select("q_id", "verdict")

    def scores(found: DataFrame) -> DataFrame:
        listed = numbered_lines(found.join(nodes, "node"), ["q_id"], "node", "chunk")
        return relevance(listed.join(questions, "q_id"), scorer, store=store, stage="relevance").join(found, ["q_id", "node"], "left_semi")

    docs, status = expand(anchors.join(texts, "node", "left_semi"), sym, verdicts, scores, keep, max_rounds)
    return docs.join(texts, "node"), status
