"""Hysteresis events, their peaks, spikes, and noise, over a relation (keys, i, x).

All windows share one partitioning by the keys, so a chain of these operators shuffles once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: list[str], order: str = "i"):
    return Window.partitionBy(*keys).orderBy(order)


def schmitt_state(df: DataFrame, keys: list[str], on: float, off: float, x: str = "x") -> Column:
    """1 from the first x >= on to the next x <= off, else 0; needs off < on. NaN changes nothing."""
    v = F.col(x)
    mark = F.when(F.isnan(v), None).when(v >= on, 1).when(v <= off, 0)
    return F.coalesce(F.last(mark, ignorenulls=True).over(_by(keys).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def schmitt(df: DataFrame, keys: list[str], on: float, off: float, end_type: int = 2, start_type: int = 1, x: str = "x", carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, event, up, down (exclusive), peak_i, peak_x, and the columns of ``carry`` at the peak: one row for each event.

    end_type: 0 drops an event that is open at the end, 1 leaves its down null, 2 closes it after the last
    sample. start_type 0 drops an event that begins with the first sample. Equal peaks: the first.
    """
    w = _by(keys)
    s = df.withColumn("_s", schmitt_state(df, keys, on, off, x)).withColumn("_n", F.max("i").over(Window.partitionBy(*keys)) + 1)
    s = s.withColumn("_up", ((F.col("_s") == 1) & (F.coalesce(F.lag("_s").over(w), F.lit(0)) == 0)).cast("int"))
    s = s.withColumn("event", F.sum("_up").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = s.where("_s = 1").groupBy(*keys, "event").agg(
        F.min("i").alias("up"),
        (F.max("i") + 1).alias("_last"),
        F.max("_n").alias("_n"),
        F.max_by(F.struct("i", *carry), F.when(~F.isnan(x), F.struct(F.col(x), -F.col("i")))).alias("_peak"),
        F.max(F.when(~F.isnan(x), F.col(x))).alias("peak_x"),
    )
    open_ = F.col("_last") == F.col("_n")
    if end_type == 0:
        inside = inside.where(~open_)
    down = F.when(open_, None).otherwise(F.col("_last")) if end_type == 1 else F.col("_last")
    if start_type == 0:
        inside = inside.where("up > 0")
    return inside.select(*keys, "event", "up", down.alias("down"), F.col("_peak.i").alias("peak_i"), "peak_x", *[F.col(f"_peak.{c}").alias(c) for c in carry])


def schmitt2(df: DataFrame, keys: list[str], high: float, low: float, x: str = "x") -> DataFrame:
    """keys, up_a, down_a, up_b, down_b: extents above ``high`` and the wider ones above ``low`` around them."""
    w = Window.partitionBy(*keys).orderBy("i")
    run = df.withColumn("_above", (F.col(x) > low).cast("int"))
    run = run.withColumn("_new", ((F.col("_above") == 1) & (F.coalesce(F.lag("_above").over(w), F.lit(0)) == 0)).cast("int"))
    run = run.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_above = 1")
    hot = F.when(F.col(x) >= high, F.col("i"))
    out = run.groupBy(*keys, "_run").agg(F.min(hot).alias("up_a"), (F.max(hot) + 1).alias("down_a"), F.min("i").alias("up_b"), (F.max("i") + 1).alias("down_b"))
    return out.where("up_a IS NOT NULL").drop("_run")


@lru_cache
def noise_factor(chunk: int, chunks: int = 1000, percent: float = 25, seed: int = 0) -> float:
    """What noise() finds in Gaussian noise of unit deviation: the low order statistic of so many chunks, by a seeded draw of fixed size."""
    spread = np.sort(np.random.default_rng(seed).standard_normal((chunk, chunks)).std(0))
    return float(spread[int(percent * chunks / 100)])


def noise(df: DataFrame, keys: list[str], chunk: int = 300, factor: float | None = 1.0, x: str = "x") -> DataFrame:
    """keys, noise: a low order statistic of the standard deviations of whole chunks, over ``factor`` (None: noise_factor())."""
    factor = noise_factor(chunk) if factor is None else factor
    part = df.withColumn("_c", F.floor(F.col("i") / chunk)).groupBy(*keys, "_c").agg(F.stddev_pop(x).alias("_sd"), F.count("*").alias("_n")).where(F.col("_n") == chunk)
    w = Window.partitionBy(*keys).orderBy("_sd", "_c")
    part = part.withColumn("_r", F.row_number().over(w)).withColumn("_m", F.count("*").over(Window.partitionBy(*keys)))
    return part.where(F.col("_r") == F.least(F.floor(0.25 * F.col("_m") + 0.5) + 1, F.col("_m"))).select(*keys, (F.col("_sd") / factor).alias("noise"))


def detect_spikes(df: DataFrame, keys: list[str], threshold: float, polarity: int = 0, dead: int = 50, x: str = "x", carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, i, x and ``carry``: peaks of events over the threshold, thinned so that no two stand under ``dead`` samples apart.

    Of two close peaks the smaller goes, of equal ones the later; each sign is thinned alone. The peaks of a
    key, few beside its samples, are taken strongest first; each looks only at the kept ones within reach.
    """
    found = None
    for sign in (1, -1):
        if polarity * sign < 0:
            continue
        side = df.withColumn("_v", F.col(x) * sign)
        peaks = schmitt(side, keys, threshold, 0.0, x="_v", carry=(x, *[c for c in carry if c != x])).withColumn("_sign", F.lit(sign))
        found = peaks if found is None else found.unionByName(peaks)
    out = found.select(*keys, F.col("peak_i").alias("i"), x, *[c for c in carry if c != x], "_sign", "peak_x")
    names = [c for c in out.columns if c not in ("_sign", "peak_x")]

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["peak_x", "i"], ascending=[False, True])
        kept: dict[int, int] = {}  # of each stretch of ``dead`` samples the one that stays
        keep = []
        for i in pdf["i"].tolist():
            k = i // max(dead, 1)
            ok = all(abs(kept.get(j, i + dead) - i) >= dead for j in (k - 1, k, k + 1))
            keep.append(ok)
            if ok:
                kept[k] = i
        return pdf.loc[np.array(keep, bool), names]

    thinned = out.groupBy(*keys, "_sign").applyInPandas(thin, out.select(*names).schema)
    return thinned.distinct()


CONTEXT = ("_hip", "_hif", "_lop", "_lof", "_abp", "_abf", "_end")


def _context(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Extremes before and after each sample: of values 12 to 24 away, of magnitudes 4 to 24 away; and the last sample's number."""
    w = Window.partitionBy(*keys).orderBy("i")
    for name, agg, value in (("hi", F.max, F.col(x)), ("lo", F.min, F.col(x)), ("ab", F.max, F.abs(F.col(x)))):
        for side, (a, b) in {"p": (-25, -13) if name != "ab" else (-25, -5), "f": (12, 24) if name != "ab" else (4, 24)}.items():
            df = df.withColumn(f"_{name}{side}", agg(value).over(w.rowsBetween(a, b)))
    return df.withColumn("_end", F.max("i").over(Window.partitionBy(*keys)))


def _clean(near: float, near_abs: float, x: str) -> Column:
    v = F.col(x)
    like = F.when(v > 0, F.greatest("_hip", "_hif") > near * v).otherwise(F.least("_lop", "_lof") < near * v)
    return (F.col("i") >= 25) & (F.col("i") + 24 <= F.col("_end")) & ~like & ~(F.greatest("_abp", "_abf") > near_abs * F.abs(v))


def clean_context(spikes: DataFrame, df: DataFrame, keys: list[str], near: float = 0.5, near_abs: float = 0.9, x: str = "x") -> DataFrame:
    """Spikes without a like sample 12 to 24 away (of the same sign, over ``near`` of the peak) or a large one 4 to 24 away."""
    hit = spikes.select(*keys, "i").join(_context(df, keys, x), [*keys, "i"])
    return hit.where(_clean(near, near_abs, x)).select(*keys, "i", x)


def clean_spikes(df: DataFrame, keys: list[str], threshold: float, polarity: int = 0, dead: int = 50, near: float = 0.5, near_abs: float = 0.9, x: str = "x") -> DataFrame:
    """detect_spikes() and clean_context() in one: the context is found beside the peaks, so the signal is not joined again."""
    found = detect_spikes(_context(df, keys, x), keys, threshold, polarity, dead, x, CONTEXT)
    return found.where(_clean(near, near_abs, x)).select(*keys, "i", x)


def threshold_line(t: Column, dots: list[tuple[float, float]]) -> Column:
    """A line through a few dots (t, y) in order, level before the first and after the last."""
    out = F.lit(float(dots[-1][1]))
    for (t0, y0), (t1, y1) in zip(dots[-2::-1], dots[:0:-1], strict=True):
        out = F.when(t <= t1, y0 + (t - t0) * ((y1 - y0) / (t1 - t0))).otherwise(out)
    return F.when(t <= dots[0][0], F.lit(float(dots[0][1]))).otherwise(out)


def between_lines(df: DataFrame, one: list[tuple[float, float]], two: list[tuple[float, float]], t: str = "t", y: str = "y") -> DataFrame:
    """Rows on or between two lines; the one whose dots are lower on average is the lower. Null and NaN are never between."""
    mean = lambda dots: sum(v for _, v in dots) / len(dots)
    low, high = (one, two) if mean(one) <= mean(two) else (two, one)
    at, v = F.col(t), F.col(y)
    return df.where(~F.isnan(v) & (v >= threshold_line(at, low)) & (v <= threshold_line(at, high)))


def find(df: DataFrame, keys: list[str], op: str, value: float | None = None, last: bool = False, x: str = "x") -> DataFrame:
    """keys, found: the first or last i whose x is ge, gt, le, lt, eq, ne the value, or is not zero; null if none. NaN only is ne."""
    v, nan = F.col(x), F.isnan(F.col(x))
    test = {
        "ge": lambda: (v >= value) & ~nan, "gt": lambda: (v > value) & ~nan, "le": lambda: (v <= value) & ~nan,
        "lt": lambda: (v < value) & ~nan, "eq": lambda: (v == value) & ~nan, "ne": lambda: (v != value) | nan, "true": lambda: (v != 0) | nan,
    }[op]()
    return df.groupBy(*keys).agg((F.max if last else F.min)(F.when(test, F.col("i"))).alias("found"))
