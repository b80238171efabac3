"""Compare ways to chunk dialogues by the answers that retrieval on them gives.

    spark-submit jobs/evaluate_methods.py --turns PATH --out DIR [--config FILE]

Every user turn is a question and the turn after it the truth. For each method (a
number of rounds a chunk) the best chunks of the question's dialogue are retrieved,
the question is answered from them and the answer is rated. Writes

* ``out/retrieved`` and ``out/rated``, partitioned by method; a method that is run again
  replaces its own partition, others stay;
* ``out/summary``, ratings by method and category, of all methods in ``out/rated``;
* ``out/calls``, every model response: a rerun asks nothing that was answered.

The config names the methods, k, and the providers: ``{"kind": "remote", "url": ...,
"model": ...}``, or the baselines quote and overlap, which need no model. White space in
a question or truth counts as one space. Rows without a conv_id or turn are left out; a
question without a next turn has no rating; one whose dialogue has no chunk in common
with it is answered from an empty context.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import config, logger, session  # noqa: E402
from tessera.functions import providers  # noqa: E402
from tessera.functions.callstore import CallStore  # noqa: E402
from tessera.functions.text import SPACE, strip  # noqa: E402
from tessera.operators import chunking, joins, vectors  # noqa: E402
from tessera.operators.similarity import nearest_within  # noqa: E402
from tessera.plans.answer import answer_and_rate, contexts, scores_by_category  # noqa: E402
from tessera.plans.storage import dealt_alike, scratch, written  # noqa: E402
from tessera.sources import dialogue  # noqa: E402

NAME = "evaluate_methods"
KINDS = {"remote": providers.Remote, "quote": providers.Quote, "overlap": providers.Overlap}
RATED = "conv_id long, turn long, label long, question string, truth string, answer string, status string, rating double, method string"
log = logger(NAME)


def provider(spec: dict) -> providers.Provider:
    return KINDS[spec["kind"]](**{k: v for k, v in spec.items() if k != "kind"})


def retrieve(turns: DataFrame, asked: DataFrame, rounds: int, k: int) -> DataFrame:
    """conv_id, turn, block, score, rk, chunk: the k best chunks of each question's dialogue. asked: conv_id, turn, v."""
    chunks = written(chunking.turn_chunks(turns, rounds, spread=True).select("conv_id", "block", "chunk"), "chunks")
    vecs = vectors.dense(vectors.hash_embedding(chunks, ["conv_id", "block"], "chunk"), ["conv_id", "block"])
    top = nearest_within(asked, vecs, ["conv_id"], "turn", "block", "v", k)
    return top.join(chunks, ["conv_id", "block"])


def replace(rows: DataFrame, path: str) -> None:
    """The methods' partitions at path; a session's settings are left alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(path)


def run(spark: SparkSession, turns: str, out: str, settings: dict | None = None) -> DataFrame:
    """Run the methods of the settings and return all rated answers as they stand."""
    settings = config(NAME) | (settings or {})
    read = spark.read.parquet(turns)
    with scratch():
        rows = written(dialogue.from_table(read.where("conv_id is not null and turn is not null")), "turns")
        line = lambda c: strip(F.regexp_replace(c, f"[{SPACE}]+", " "))
        found = joins.questions(rows, spread=True).select("conv_id", F.col("turn_ord").alias("turn"), line("question").alias("question"), line("answer").alias("truth"), (F.col("conv_id") % 5).alias("label"))
        questions = written(found, "questions")
        log.info("read %s turns with %s questions from %s", rows.count(), questions.count(), turns)
        asked = written(vectors.dense(vectors.hash_embedding(questions, ["conv_id", "turn"], "question"), ["conv_id", "turn"]), "asked")
        retrieved = None
        for method, rounds in settings["methods"].items():
            top = retrieve(rows, asked, rounds, settings["k"]).withColumn("method", F.lit(method))
            retrieved = top if retrieved is None else retrieved.unionByName(top)
        replace(retrieved, f"{out}/retrieved")
        names = list(settings["methods"])
        best = spark.read.parquet(f"{out}/retrieved").where(F.col("method").isin(names))
        by = ["conv_id", "turn"]  # texts are dealt by question once, for all methods
        each = questions.repartition(*by).withColumn("method", F.explode(F.array(*map(F.lit, names))))
        store = CallStore(spark, f"{out}/calls")
        with dealt_alike(spark):
            asked = contexts(each, best.repartition(*by), ["method", *by], "rk", "chunk")
            rated = answer_and_rate(asked, provider(settings["answerer"]), provider(settings["judge"]), store=store)
        replace(rated.select("conv_id", "turn", "label", "question", "truth", "answer", "status", "rating", "method"), f"{out}/rated")
        for seen in store.observed:
            log.info("asked %s", seen)
    whole = spark.read.schema(RATED).parquet(f"{out}/rated")
    scores_by_category(whole, ["method"]).write.mode("overwrite").parquet(f"{out}/summary")
    log.info("wrote %s ratings to %s", whole.count(), f"{out}/rated")
    return whole


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for a in ("turns", "out"):
        p.add_argument(f"--{a}", required=True)
    p.add_argument("--config")
    a = p.parse_args()
    spark = session(NAME)
    try:
        run(spark, a.turns, a.out, config(NAME, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
