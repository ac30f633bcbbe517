"""Grids and adaptive smoothing: mesh relations, thinning of pictures, histogram smoothing by counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .smooth import gaussian_weights, kernel


def mesh(spark: SparkSession, rows: int, columns: int, norm: bool = False) -> DataFrame:
    """x, y of every cell, made from one range."""
    cell = spark.range(rows * columns)
    x, y = F.col("id") % columns, F.floor(F.col("id") / columns)
    if norm:
        x, y = x / float(columns - 1), y / float(rows - 1)
    return cell.select(x.alias("x"), y.alias("y"))


def blur(df: DataFrame, image: str, sigma: float, v: str = "v", normalise: bool = True) -> DataFrame:
    """Separable Gaussian: along rows, then along columns."""
    w = gaussian_weights(sigma)
    flat = df.withColumn("_h", kernel([image, "y"], w, v, "x", normalise))
    return flat.withColumn(v, kernel([image, "x"], w, "_h", "y", normalise)).drop("_h")


def adaptive_contrast(df: DataFrame, image: str, sigma: float, v: str = "v") -> DataFrame:
    """(x - blur) over (local deviation + a quarter of its mean over the picture)."""
    mean = blur(df.withColumn("_m", F.col(v).cast("double")), image, sigma, "_m")
    rest = mean.withColumn("_d", F.col(v) - F.col("_m")).withColumn("_q", (F.col(v) - F.col("_m")) ** 2)
    local = blur(rest, image, sigma, "_q").withColumn("_r", F.sqrt("_q"))
    scale = F.avg("_r").over(Window.partitionBy(image)) / 4
    return local.withColumn("_s", F.col("_r") + scale).withColumn(v, F.coalesce(F.try_divide("_d", "_s"), F.lit(0.0))).drop("_m", "_d", "_q", "_r", "_s")


def _neighbours(p: np.ndarray) -> list[np.ndarray]:
    q = np.pad(p, 1)
    at = lambda dy, dx: q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx]
    return [at(-1, 0), at(-1, 1), at(0, 1), at(1, 1), at(1, 0), at(1, -1), at(0, -1), at(-1, -1)]


def thin_once(p: np.ndarray) -> np.ndarray:
    """One step of Zhang and Suen's thinning: its two passes."""
    for first in (True, False):
        n = _neighbours(p)
        total = sum(x.astype(int) for x in n)
        turns = sum(((a == 0) & (b == 1)).astype(int) for a, b in zip(n, n[1:] + n[:1], strict=True))
        up, right, down, left = n[0], n[2], n[4], n[6]
        edge = (up * right * down == 0) & (right * down * left == 0) if first else (up * right * left == 0) & (up * down * left == 0)
        p = np.where((p == 1) & (total >= 2) & (total <= 6) & (turns == 1) & edge, 0, p)
    return p


def thin(df: DataFrame, image: str, steps: int | None = 1, v: str = "v") -> DataFrame:
    """(image, y, x, v): thinned by so many steps, or until nothing changes; a task holds one picture."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values(["y", "x"]).reset_index(drop=True)
        p = np.zeros((int(s.y.max()) + 1, int(s.x.max()) + 1), int)
        p[s.y, s.x] = (s[v] != 0).astype(int)
        k = 0
        while steps is None or k < steps:
            q = thin_once(p)
            if (q == p).all():
                break
            p, k = q, k + 1
        s[v] = p[s.y, s.x]
        return s

    cols = df.select(image, "y", "x", v)
    return cols.groupBy(image).applyInPandas(run, cols.schema)


def dynamic_rebin(df: DataFrame, keys: list[str], least: float, x: str = "x") -> DataFrame:
    """keys, i, x: each count spread by a Gaussian whose reach holds more than ``least`` counts; sums stay.

    The reach at t is the smallest k with more than ``least`` within t - k .. t + k, found on prefix sums,
    or 0 if even the whole series has too few; the variance is reach squared plus one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("i")
        n = s[x].to_numpy(float)
        total, t = np.concatenate([[0], np.cumsum(n)]), np.arange(len(n))
        low, high = np.zeros(len(n), int), np.full(len(n), len(n))
        while (low < high).any():  # all reaches by bisection at once
            mid = (low + high) // 2
            ok = total[np.minimum(t + mid + 1, len(n))] - total[np.maximum(t - mid, 0)] > least
            high, low = np.where(ok, mid, high), np.where(ok, low, mid + 1)
        reach = np.where(low >= len(n), 0, low)
        out = np.zeros(len(n))
        # A Gaussian is cut where it is under 1e-17 of its middle, so work follows the reaches, not the square of the series.
        for k in np.flatnonzero(n):
            cut = int(9 * np.sqrt(reach[k] ** 2 + 1)) + 1
            near = slice(max(0, k - cut), k + cut + 1)
            w = np.exp(-0.5 * (t[near] - k) ** 2 / (reach[k] ** 2 + 1))
            out[near] += w / w.sum() * n[k]
        return s.assign(**{x: out})[[*keys, "i", x]]

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys, "i").schema)
    return df.groupBy(*keys).applyInPandas(run, f"{head}, `{x}` double")
