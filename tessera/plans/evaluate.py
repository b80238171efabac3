"""Evidence recall at k and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 7, 9, 11)


def recall_at_k(ranked: DataFrame, truth: DataFrame, group: list[str], query: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """group, k, recall: mean over queries of the share of truths that one of the first k texts contains.

    ranked: group, query, rk, chunk (ranked once, to the largest k). truth: query,
    t_ord, truth. A query without truths counts as 0.
    """
    first = ranked.join(truth, query).where(F.contains("chunk", "truth")).groupBy(*group, query, "t_ord").agg(F.min("rk").alias("rk"))
    wanted = truth.groupBy(query).agg(F.count("*").alias("n_truth"))
    asked = ranked.select(*group, query).distinct()
    at = asked.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    hits = at.join(first.select(*group, query, F.col("rk").alias("__rk")), [*group, query], "left").groupBy(*group, query, "k").agg(F.sum((F.col("__rk") <= F.col("k")).cast("int")).alias("hits"))
    share = hits.join(wanted, query, "left").withColumn("r", F.coalesce(F.coalesce("hits", F.lit(0)) / F.col("n_truth"), F.lit(0.0)))
    return share.groupBy(*group, "k").agg(F.round(F.avg("r"), 6).alias("recall"))


def recall_table(recall: DataFrame, group: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row per group with top1, top3, ... columns."""
    wide = recall.groupBy(group).pivot("k", list(ks)).agg(F.first("recall"))
    return wide.select(group, *[F.col(str(k)).alias(f"top{k}") for k in ks])
