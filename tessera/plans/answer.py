"""Answering, judging and scoring as table stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.callstore import CallStore
from tessera.functions.providers import PROMPTS, Provider, call
from tessera.functions.text import extract_json, json_field
from tessera.operators.chunking import ordered_join

# The numbers that questions are labelled with.
CATEGORIES = {4: "single-hop", 1: "multi-hop", 2: "temporal", 3: "open-domain"}


def render(prompt: str, **fields: Column) -> Column:
    """A prompt with its {fields} filled from columns (null as an empty text)."""
    out = F.lit(PROMPTS[prompt])
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c, F.lit("")))
    return out


def answer(rows: DataFrame, provider: Provider, prompt: str = "answer", **options) -> DataFrame:
    """rows (question, context) with answer and status; what doesn't parse is taken as the answer itself."""
    out = call(rows, provider, render(prompt, question=F.col("question"), context=F.col("context")), **options)
    picked = json_field(extract_json(F.col("response")), "$.answer")
    return out.withColumn("answer", F.when(F.col("status") == "error", "error").otherwise(F.coalesce(picked, "response")))


def filter_evidence(rows: DataFrame, provider: Provider, **options) -> DataFrame:
    """rows (question, context) with evidence: the provider's sentences, or the whole context if it fails."""
    out = call(rows, provider, render("filter", question=F.col("question"), context=F.col("context")), **options)
    got = F.from_json(json_field(extract_json(F.col("response")), "$.filtered_text"), "array<string>")
    return out.withColumn("evidence", F.coalesce(F.array_join(got, "\n"), "context"))


def judge(rows: DataFrame, provider: Provider, scale: str = "0-100", **options) -> DataFrame:
    """rows (question, truth, answer) with rating, null where judging failed."""
    if scale not in ("0-1", "0-100"):
        raise ValueError(f"unknown scale {scale}")
    prompt = render("judge_" + scale.replace("-", "_"), question=F.col("question"), truth=F.col("truth"), answer=F.col("answer"))
    out = call(rows, provider, prompt, **options)
    return out.withColumn("rating", json_field(extract_json(F.col("response")), "$.rating", "double"))


def summarize(rows: DataFrame, provider: Provider, **options) -> DataFrame:
    """rows (context) with summary, empty where the call or its parsing failed."""
    out = call(rows, provider, render("summary", context=F.col("context")), **options)
    return out.withColumn("summary", F.coalesce(json_field(extract_json(F.col("response")), "$.summary"), F.lit("")))


def boundaries(rows: DataFrame, provider: Provider, prompt: str = "boundaries", **options) -> DataFrame:
    """rows (context) with one row per boundary index that the provider names."""
    out = call(rows, provider, render(prompt, context=F.col("context")), **options)
    got = F.from_json(json_field(extract_json(F.col("response")), "$.topic_boundaries"), "array<struct<boundary_index:int,reason:string>>")
    return out.withColumn("b", F.explode(got)).select(*rows.columns, F.col("b.boundary_index").alias("boundary"), F.col("b.reason").alias("reason")).where("boundary >= 0")


def category(label: Column) -> Column:
    out = F.lit("Unknown")
    for k, v in CATEGORIES.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def scores_by_category(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, category, rating, n, errors of rows (category label, rating or null); categories without a rating are absent."""
    g = rows.groupBy(*(keys or []), category(F.col("label")).alias("category"))
    return g.agg(F.avg("rating").alias("rating"), F.count("rating").alias("n"), F.sum(F.col("rating").isNull().cast("bigint")).alias("errors")).where("n > 0")


def overall(rows: DataFrame) -> DataFrame:
    """macro (mean of the categories' means), micro (mean of all ratings), errors."""
    by = scores_by_category(rows)
    return by.agg(F.avg("rating").alias("macro"), (F.sum(F.col("rating") * F.col("n")) / F.sum("n")).alias("micro"), F.sum("errors").alias("errors"))


def describe(rows: DataFrame) -> DataFrame:
    """category, n, mean, deviation, least, most of the ratings of each category."""
    g = rows.where("rating is not null").groupBy(category(F.col("label")).alias("category"))
    return g.agg(F.count("*").alias("n"), F.avg("rating").alias("mean"), F.stddev_samp("rating").alias("deviation"), F.min("rating").alias("least"), F.max("rating").alias("most"))


def relevance(rows: DataFrame, provider: Provider, **options) -> DataFrame:
    """rows (q_id, question, context) with a row per scored node: q_id, node, score. Replies that don't parse score nothing."""
    out = call(rows, provider, render("relevance", question=F.col("question"), context=F.col("context")), **options)
    got = F.from_json(json_field(extract_json(F.col("response")), "$.results"), "array<struct<doc_id:bigint,score:double>>")
    return out.select("q_id", F.inline(got)).select("q_id", F.col("doc_id").alias("node"), "score")


def predict(rows: DataFrame, provider: Provider, **options) -> DataFrame:
    """rows (context) with predicted: the next turn as the provider writes it, empty where the call failed."""
    out = call(rows, provider, render("predict", context=F.col("context")), **options)
    return out.withColumn("predicted", F.coalesce("response", F.lit("")))


def sufficient(rows: DataFrame, provider: Provider, **options) -> DataFrame:
    """rows (question, context) with verdict: 0, 1 or 2, null where the call or its parsing failed."""
    out = call(rows, provider, render("sufficiency", question=F.col("question"), context=F.col("context")), **options)
    return out.withColumn("verdict", json_field(extract_json(F.col("response")), "$.result", "int"))


def contexts(questions: DataFrame, retrieved: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """questions with context: what was retrieved for each (keys), in order, a line a document; empty if nothing was."""
    joined = retrieved.groupBy(*keys).agg(ordered_join(order, text, "\n").alias("context"))
    return questions.join(joined, keys, "left").withColumn("context", F.coalesce("context", F.lit("")))


def long_contexts(questions: DataFrame, lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """questions with context: all lines of their key, one text for all questions of a key."""
    return contexts(questions, lines, [key], order, text)


def answer_and_rate(rows: DataFrame, answerer: Provider, judge_: Provider, scale: str = "0-100", prompt: str = "answer", store: CallStore | None = None) -> DataFrame:
    """rows (question, truth, context, label) with answer, status and rating (null where judging failed).

    Answers are in the store before they are judged, so the answers that are rated are
    those of the result; with a store of a known path a rerun asks nothing again. The
    rows are evaluated once.
    """
    store = store or CallStore(rows.sparkSession)
    answered = answer(rows, answerer, prompt, store=store, stage="answers").select(*rows.columns, "answer", F.col("status").alias("answer_status"))
    rated = judge(answered, judge_, scale, store=store, stage="ratings", hold=False)
    return rated.select(*rows.columns, "answer", F.col("answer_status").alias("status"), "rating")
