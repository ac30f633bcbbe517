"""Smoothing, medians, trends and morphology over (keys, i, x): windows over one partitioning, no self joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], order: str = "i"):
    return Window.partitionBy(*keys).orderBy(order)


def boxcar(keys: list[str], n: int, x: str = "x", order: str = "i") -> Column:
    """Mean of the 2 n + 1 samples around; fewer at the ends."""
    return F.avg(x).over(_w(keys, order).rowsBetween(-n, n))


def kernel(keys: list[str], weights: list[float], x: str = "x", order: str = "i", normalise: bool = True) -> Column:
    """Sum of an odd kernel around each sample; at the ends over the weights that apply, or else as if zeros followed."""
    half = len(weights) // 2
    total, weight = F.lit(0.0), F.lit(0.0)
    for k, c in enumerate(weights):
        v = F.lag(x, half - k).over(_w(keys, order)) if k <= half else F.lead(x, k - half).over(_w(keys, order))
        total = total + F.coalesce(v * c, F.lit(0.0))
        weight = weight + F.when(v.isNotNull(), F.lit(c)).otherwise(F.lit(0.0))
    return total / weight if normalise else total


def gaussian_weights(sigma: float, reach: float = 4) -> list[float]:
    n = math.ceil(reach * sigma)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-n, n + 1)]
    return [v / sum(raw) for v in raw]


def gaussian_blur(keys: list[str], sigma: float, x: str = "x", order: str = "i", normalise: bool = False) -> Column:
    return kernel(keys, gaussian_weights(sigma), x, order, normalise)


def median3(keys: list[str], x: str = "x", order: str = "i") -> Column:
    """Median of three; the ends repeat."""
    w = _w(keys, order)
    v = F.col(x)
    return F.sort_array(F.array(F.coalesce(F.lag(x).over(w), v), v, F.coalesce(F.lead(x).over(w), v)))[1]


def median_n(keys: list[str], n: int, x: str = "x", order: str = "i") -> Column:
    """Median of the 2 n + 1 samples around, where they all exist; else the sample."""
    got = F.sort_array(F.collect_list(x).over(_w(keys, order).rowsBetween(-n, n)))
    return F.when(F.size(got) == 2 * n + 1, got[n]).otherwise(F.col(x))


def detrend(keys: list[str], degree: int = 1, x: str = "x") -> Column:
    """x less its mean (0) or least-squares line (1) over the whole series."""
    w = Window.partitionBy(*keys)
    if degree == 0:
        return F.col(x) - F.avg(x).over(w)
    if degree != 1:
        raise ValueError("degrees over one: use spectral.detrend_polynomial")
    t = F.col("i").cast("double")
    slope = F.coalesce(F.try_divide(F.covar_pop(x, t).over(w), F.var_pop(t).over(w)), F.lit(0.0))
    return F.col(x) - (F.avg(x).over(w) + slope * (t - F.avg(t).over(w)))


def hermite(df: DataFrame, keys: list[str], n: int, bias: float = 0, tension: float = 0, x: str = "x") -> DataFrame:
    """keys, i, k, y: n points a step by cubic Hermite interpolation; the ends repeat."""
    w = _w(keys)
    y1 = F.col(x)
    s = df.withColumn("_0", F.coalesce(F.lag(x).over(w), y1)).withColumn("_2", F.lead(x).over(w))
    s = s.withColumn("_3", F.coalesce(F.lead(x, 2).over(w), F.col("_2"))).withColumn("_last", F.col("_2").isNull())
    s = s.withColumn("k", F.explode(F.when(F.col("_last"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(n - 1)))))
    m = F.col("k") / F.lit(float(n))
    y0, y2, y3 = F.col("_0"), F.col("_2"), F.col("_3")
    up, down = (1 + bias) * (1 - tension) / 2, (1 - bias) * (1 - tension) / 2
    m0, m1 = (y1 - y0) * up + (y2 - y1) * down, (y2 - y1) * up + (y3 - y2) * down
    a0, a1, a2, a3 = 2 * m**3 - 3 * m**2 + 1, m**3 - 2 * m**2 + m, m**3 - m**2, -2 * m**3 + 3 * m**2
    return s.select(*keys, "i", "k", F.when(F.col("_last"), y1).otherwise(a0 * y1 + a1 * m0 + a2 * m1 + a3 * y2).alias("y"))


def morphology(df: DataFrame, image: str, op: str, neighbours: int = 4, v: str = "v") -> DataFrame:
    """(image, y, x, v): erode, dilate or edge with 4 or 8 neighbours; beyond the border nothing counts."""
    pick = F.max if op == "dilate" else F.min
    row, col = Window.partitionBy(image, "y").orderBy("x").rowsBetween(-1, 1), Window.partitionBy(image, "x").orderBy("y").rowsBetween(-1, 1)
    flat = df.withColumn("_h", pick(v).over(row))
    if neighbours == 8:
        out = flat.withColumn("_m", pick("_h").over(col))
    else:
        least = F.greatest if op == "dilate" else F.least
        out = flat.withColumn("_m", least(F.col("_h"), pick(v).over(col)))
    if op == "edge":
        out = out.withColumn("_m", F.when((F.col(v) != 0) & (F.col("_m") == 0), F.col(v)).otherwise(F.lit(0).cast(df.schema[v].dataType)))
    return out.withColumn(v, F.col("_m")).drop("_h", "_m")


def block_mean(df: DataFrame, keys: list[str], n: int, x: str = "x") -> DataFrame:
    """Means of blocks of n samples; a short last block goes."""
    out = df.groupBy(*keys, F.floor(F.col("i") / n).alias("block")).agg(F.avg(x).alias("x"), F.count("*").alias("_n"))
    return out.where(F.col("_n") == n).drop("_n")
