"""Places within keys without a window over a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.storage import written


FILE_NUMBER = r"^part-(\d+)"  # the place of a file in the order that a sorted table was written in


def packed(high: str, low: str, width: int) -> Column:
    """high * width + low as one number; a low that does not fit (0 to width - 1) is an error and not another row's number."""
    fits = F.col(low).between(0, width - 1) | F.col(low).isNull()
    return F.when(fits, F.col(high) * width + F.col(low)).otherwise(F.raise_error(F.lit(f"{low} is not below {width}")))


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with rn, their place (from 0) within their key by ``order``, and n, the rows of the key.

    Rows are sorted by range over all tasks, so a key of any size is cut between them,
    and written; a row's place is its place in its file behind the key's rows in the
    files before. Only one count a key and file is added up by key. Null keys are one
    key; rows that tie in ``order`` have places of their own, in any order.
    """
    cols = rows.columns
    ordered = written(rows.orderBy(*keys, *order), "ordered")
    at = ordered.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    held = at.groupBy(*keys, "__file").agg(F.min("__at").alias("__first"), F.count("*").alias("__held"))
    number = F.regexp_extract("__file", FILE_NUMBER, 1).cast("long")
    w = Window.partitionBy(*keys)
    before = F.sum("__held").over(w.orderBy(number, "__file").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__file").alias("__f"), (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__held").over(w).alias("n"))
    same = F.col("__file") == F.col("__f")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return at.join(held, same).select(*cols, (F.col("__at") + F.col("__shift")).alias("rn"), "n")
