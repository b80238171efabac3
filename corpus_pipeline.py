"""The training-data pipeline: toxicity, line dedup, n-gram Jaccard join, decontamination, packing.

Every stage takes the documents that its predecessor kept (rereading them from
Parquet) and returns the columns of documents, the last one the packed pieces.
Columns beside doc_id and text pass through, whatever their names; an empty table
gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, line_dedup, ngram_join, packing, toxicity
from tessera.llm.common import Workspace


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier calls toxic (a score of 0.5 or more).

    Null and empty texts have the score of a text without any telling stem and stay;
    rows that repeat a doc_id are judged each by its text; without usable labels all stay.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that at least five documents hold, but in the one with the largest doc_id; n_chars follows the text.

    A null text becomes an empty one. Rows that share a doc_id are one document, as are
    all without one (below every other); each row keeps its own lines, and repeated rows stay repeated.
    """
    out = line_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the smallest doc_id.

    Null and empty texts, and rows without a doc_id, are linked with nothing and stay;
    rows that repeat the kept doc_id with a linked text stay too.
    """
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents into which a benchmark item leaks (an alignment of 0.6 of the item's full score, or more).

    Null and empty texts and items match nothing; rows that repeat a doc_id are judged each by its text.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the documents into pieces of power-of-two lengths, with their token ids.

    A null or empty text is its end token alone; repeated rows are packed as often as they occur.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Tokenisation and classifier training are no SQL; tests compare run() with the stages done plainly.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each but the last returns is written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
