"""Time-series operators: forward and centred means, valleys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forward_mean(series: DataFrame, keys: list[str], order: list[str], value: str, ahead: int = 3) -> DataFrame:
    """series with fwd: mean of the next ``ahead`` values (fewer at the end; the last row of a key is dropped)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = series.withColumn("fwd", F.avg(value).over(w.rowsBetween(1, ahead)))
    return rows.where("fwd is not null")


def smooth3(series: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """series with smooth: centred mean of three, zeros beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    near = lambda f: F.coalesce(f(value).over(w), F.lit(0.0))
    return series.withColumn("smooth", (near(F.lag) + F.col(value) + near(F.lead)) / 3)


def _levels(x: np.ndarray) -> list[np.ndarray]:
    """Maxima of all runs of 1, 2, 4, ... values, by where they begin."""
    out = [x]
    while 2 << (len(out) - 1) <= len(x):
        half = 1 << (len(out) - 1)
        out.append(np.maximum(out[-1][:-half], out[-1][half:]))
    return out


def _reach(levels: list[np.ndarray], start: np.ndarray, most: np.ndarray, left: bool) -> np.ndarray:
    """How far from each start (itself left out) the values to one side stay at or below ``most``."""
    n, far = len(levels[0]), np.zeros(len(start), int)
    for j in range(len(levels) - 1, -1, -1):
        size = 1 << j
        first = start - far - size if left else start + far + 1
        ok = (first >= 0) & (first + size <= n)
        ok[ok] = levels[j][first[ok]] <= most[ok]
        far[ok] += size
    return far


def _lowest(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minima of x from first to last, from the levels of -x."""
    size = last - first + 1
    j = np.frexp(size)[1] - 1
    return -np.array([max(levels[k][a], levels[k][b - (1 << k) + 1]) for k, a, b in zip(j, first, last)])


def peaks(x: np.ndarray, prominence: float, distance: int, width: float) -> np.ndarray:
    """Places of local maxima, filtered by distance (highest first), prominence, then width at half prominence.

    Ends of slopes are found by jumps over runs of doubling length, so the time is
    n log n whatever the shape of the series. ``prominence`` must be positive.
    """
    n = len(x)
    if n < 3:
        return np.empty(0, int)
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))  # of runs of equal values
    end = np.concatenate([begin[1:], [n]]) - 1
    v = x[begin]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    p = (begin[top] + end[top]) // 2
    if distance > 1:
        keep = np.ones(len(p), bool)
        for k in np.argsort(x[p], kind="stable")[::-1]:
            if keep[k]:
                for step in (-1, 1):
                    j = k + step
                    while 0 <= j < len(p) and abs(p[j] - p[k]) < distance:
                        keep[j] = False
                        j += step
        p = p[keep]
    if not len(p):
        return p
    high, low = _levels(x), _levels(-x)
    a, b = p - _reach(high, p, x[p], True), p + _reach(high, p, x[p], False)
    drop = x[p] - np.maximum(_lowest(low, a, p), _lowest(low, p, b))
    p, drop = p[drop >= prominence], drop[drop >= prominence]
    level = x[p] - drop / 2
    over = np.nextafter(-level, -np.inf)  # a value is over the level if its negative is at most this
    a, b = p - _reach(low, p, over, True) - 1, p + _reach(low, p, over, False) + 1  # both exist: the slopes go below the level
    left = np.where(x[a] < level, a + (level - x[a]) / np.where(x[a] < level, x[np.minimum(a + 1, n - 1)] - x[a], 1), a)
    right = np.where(x[b] < level, b - (level - x[b]) / np.where(x[b] < level, x[b - 1] - x[b], 1), b)
    return p[right - left >= width]


def valleys(series: DataFrame, keys: list[str], order: list[str], value: str, prominence: float = 0.05, distance: int = 3, width: float = 2) -> DataFrame:
    """keys, i: places (from 0) of the valleys of each key's smoothed series; one key at a time, keys in parallel."""
    kinds = dict(series.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", i long"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        x = g[value].to_numpy(float)
        pad = np.concatenate([[0.0], x, [0.0]])
        at = peaks(-(pad[:-2] + pad[1:-1] + pad[2:]) / 3, prominence, distance, width)
        return pd.DataFrame({**{k: [g[k].iloc[0]] * len(at) for k in keys}, "i": at.astype("int64")})

    return series.select(*dict.fromkeys([*keys, *order, value])).groupBy(*keys).applyInPandas(run, schema)


def prefixes(lines: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """lines with prefix: the key's lines up to and with this one, joined by line ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("prefix", F.array_join(F.collect_list(text).over(w), "\n"))


def rolling(lines: DataFrame, keys: list[str], order: str, text: str, most: int = 64) -> DataFrame:
    """lines with context: the last ``most`` lines up to and with this one, joined by line ends, led by how many came before them.

    The frame is bounded, so neither a row nor the memory of a task grows with the
    length of a key, and what is written is ``most`` lines a line and no square.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.greatest(F.row_number().over(w) - most, F.lit(0))
    shown = F.array_join(F.collect_list(text).over(w.rowsBetween(1 - most, 0)), "\n")
    lead = F.when(before > 0, F.concat(F.lit("("), before.cast("string"), F.lit(" earlier lines)\n"))).otherwise("")
    return lines.withColumn("context", F.concat(lead, shown))


def forward_similarity(turns: DataFrame, predicted: DataFrame, actual: DataFrame, keys: list[str], order: str, ahead: int = 3) -> DataFrame:
    """keys, order, sim: mean inner product of the vector predicted at a turn with those of the next ``ahead`` turns (last turns are absent).

    predicted, actual: keys, order, bucket, weight. Turns without common buckets count as 0.
    """
    t = turns.select(*keys, order)
    near = t.withColumn("__j", F.explode(F.sequence(F.col(order) + 1, F.col(order) + ahead))).join(t.withColumnRenamed(order, "__j"), [*keys, "__j"])
    a = near.join(predicted.withColumnRenamed("weight", "__a"), [*keys, order])
    b = actual.select(*keys, F.col(order).alias("__j"), "bucket", F.col("weight").alias("__b"))
    dots = a.join(b, [*keys, "__j", "bucket"]).groupBy(*keys, order).agg(F.sum(F.col("__a") * F.col("__b")).alias("__s"))
    n = near.groupBy(*keys, order).agg(F.count("*").alias("__n"))
    return n.join(dots, [*keys, order], "left").select(*keys, order, F.round(F.coalesce("__s", F.lit(0.0)) / F.col("__n"), 6).alias("sim"))
