"""Similarity over dense (array<float>) and sparse (id, bucket, weight) vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_blank

BUCKETS = 64


def hash_embedding(texts: DataFrame, id_cols: list[str], text: str, buckets: int = BUCKETS) -> DataFrame:
    """id_cols, bucket, weight: unit-length counts of lower-case words by md5 bucket. Blank texts have no rows (zero vectors)."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]+"), F.lit(0)))
    rows = texts.where(~is_blank(F.col(text))).select(*id_cols, words.alias("__w"))
    bucket = (F.conv(F.substring(F.md5(F.col("__w").cast("binary")), 1, 4), 16, 10).cast("bigint") % buckets).alias("bucket")
    counts = rows.select(*id_cols, bucket).groupBy(*id_cols, "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*id_cols)
    return counts.withColumn("weight", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(w))).drop("n")


def dense(sparse: DataFrame, id_cols: list[str], buckets: int = BUCKETS) -> DataFrame:
    """id_cols, v: sparse vectors as arrays of ``buckets`` numbers."""
    rows = sparse.groupBy(*id_cols).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    each = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.try_element_at("m", b.cast("long")), F.lit(0.0)))
    return rows.select(*id_cols, each.alias("v"))


def sparse_scores(left: DataFrame, right: DataFrame, on: list[str], ids: list[str]) -> DataFrame:
    """ids, score: inner products by an equi-join on the shared bucket (pairs without one are absent)."""
    j = left.withColumnRenamed("weight", "__a").join(right.withColumnRenamed("weight", "__b"), [*on, "bucket"])
    return j.groupBy(*ids).agg(F.round(F.sum(F.col("__a") * F.col("__b")), 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def top_k(scores: DataFrame, group: list[str], item: str, k: int, score: str = "score") -> DataFrame:
    """scores with rk <= k: best first, ties to the smaller item (a partial top-k per task, then one per group)."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), item)
    return scores.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def sparse_pairs(sparse: DataFrame, key: str, item: str) -> DataFrame:
    """key, i, j, sim: inner products of the items i < j of one key that share a bucket."""
    a = sparse.select(key, "bucket", F.col(item).alias("i"), F.col("weight").alias("__a"))
    b = sparse.select(key, "bucket", F.col(item).alias("j"), F.col("weight").alias("__b"))
    return a.join(b, [key, "bucket"]).where("i < j").groupBy(key, "i", "j").agg(F.round(F.sum(F.col("__a") * F.col("__b")), 6).alias("sim"))


def by_position(top: DataFrame, group: list[str], item: str) -> DataFrame:
    """top with ord: the items of each group in their own order, from 1."""
    return top.withColumn("ord", F.row_number().over(Window.partitionBy(*group).orderBy(item)))


def cells(items: DataFrame, sims: DataFrame, key: str, item: str) -> DataFrame:
    """key, i, j, value: the whole matrix of each key's items, 0 where no similarity is given and 1 on the diagonal."""
    a, b = items.select(key, F.col(item).alias("i")), items.select(key, F.col(item).alias("j"))
    half = a.join(b, key).where("i < j").join(sims, [key, "i", "j"], "left").select(key, "i", "j", F.coalesce("sim", F.lit(0.0)).alias("value"))
    own = a.select(key, "i", F.col("i").alias("j"), F.lit(1.0).alias("value"))
    return half.unionByName(half.select(key, F.col("j").alias("i"), F.col("i").alias("j"), "value")).unionByName(own)
