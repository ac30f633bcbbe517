"""Nearest, range and polygon joins, correlograms and kernel regression, without all-pairs joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(a: DataFrame, b: DataFrame, keys: list[str], max_dt: float = float("inf"), t: str = "t", index: str = "i") -> DataFrame:
    """keys, i, j: for each event of a the nearest of b, if nearer than max_dt, else null. Equal distances: the smaller j.

    Both sides travel once, to the keys' partition, and the neighbours come from two running windows.
    """
    one = b.groupBy(*keys, t).agg(F.min(index).alias("_j"))
    left = a.select(*keys, F.col(t).alias("_t"), F.col(index).alias("i"), F.lit(None).cast("long").alias("_j"))
    right = one.select(*keys, F.col(t).alias("_t"), F.lit(None).cast("long").alias("i"), F.col("_j").cast("long").alias("_j"))
    both = left.unionByName(right).withColumn("_r", F.when(F.col("_j").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_j").alias("j"))))
    w = Window.partitionBy(*keys).orderBy("_t")
    both = both.withColumn("_p", F.last("_r", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_f", F.first("_r", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    dp, df_ = F.col("_t") - F.col("_p.t"), F.col("_f.t") - F.col("_t")
    back = F.col("_f").isNull() | (dp < df_) | ((dp == df_) & (F.col("_p.j") <= F.col("_f.j")))
    pick = F.when(F.col("_p").isNotNull() & back, F.struct(dp.alias("d"), F.col("_p.j").alias("j"))).when(F.col("_f").isNotNull(), F.struct(df_.alias("d"), F.col("_f.j").alias("j")))
    out = both.where("i IS NOT NULL").withColumn("_b", pick)
    return out.select(*keys, "i", F.when(F.col("_b.d") < max_dt, F.col("_b.j")).alias("j"))


def mutual_nearest(a: DataFrame, b: DataFrame, keys: list[str], max_dt: float = float("inf"), t: str = "t", index: str = "i") -> DataFrame:
    """keys, i, j of events that are each other's nearest."""
    there = nearest(a, b, keys, max_dt, t, index).where("j IS NOT NULL")
    back = nearest(b, a, keys, max_dt, t, index).where("j IS NOT NULL").select(*keys, F.col("j").alias("i"), F.col("i").alias("j"))
    return there.join(back, [*keys, "i", "j"])


def correlogram(a: DataFrame, b: DataFrame, keys: list[str], dt: float, n: int, whole: bool = False, t: str = "t") -> DataFrame:
    """keys, lag (-n .. n), pairs: counts of b at each lag after a; zeros too.

    Whole-number times use bins floor(y / dt) - floor(x / dt); others floor(y / dt - x / dt + 1 / 2). The
    range join is an equality on buckets of the reach, so work follows the pairs within reach.
    """
    reach = (n + 1) * dt
    bucket = lambda c: F.floor(c / F.lit(reach))
    left = a.select(*keys, F.col(t).alias("_x")).withColumn("_b", F.explode(F.array(*[bucket(F.col("_x")) + k for k in (-1, 0, 1)])))
    right = b.select(*keys, F.col(t).alias("_y")).withColumn("_b", bucket(F.col("_y")))
    step = F.lit(dt)
    lag = F.floor(F.col("_y") / step) - F.floor(F.col("_x") / step) if whole else F.floor(F.col("_y") / step - F.col("_x") / step + 0.5)
    found = left.join(right, [*keys, "_b"]).withColumn("lag", lag.cast("int")).where(F.abs("lag") <= n).groupBy(*keys, "lag").agg(F.count("*").alias("c"))
    grid = a.select(*keys).distinct().withColumn("lag", F.explode(F.sequence(F.lit(-n), F.lit(n))))
    return grid.join(found, [*keys, "lag"], "left").select(*keys, "lag", F.coalesce("c", F.lit(0)).alias("pairs"))


def in_polygon(corners: list[tuple[float, float]], x: str = "x", y: str = "y") -> Column:
    """(x, y) within a convex polygon of a few corners given in order, either way round; the border counts. Null where x or y is."""
    px, py = F.col(x), F.col(y)
    side = [(px - x0) * (y1 - y0) - (py - y0) * (x1 - x0) for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1], strict=True)]
    left, right = F.lit(True), F.lit(True)
    for c in side:
        left, right = left & (c >= 0), right & (c <= 0)
    return left | right


def polygon_area(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, area of (keys, i, x, y): positive if the corners run counter-clockwise."""
    w = Window.partitionBy(*keys).orderBy("i")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x0, y0 = F.first("x").over(all_), F.first("y").over(all_)
    s = df.withColumn("_x", F.col("x") - x0).withColumn("_y", F.col("y") - y0)
    s = s.withColumn("_nx", F.coalesce(F.lead("_x").over(w), F.lit(0.0))).withColumn("_ny", F.coalesce(F.lead("_y").over(w), F.lit(0.0)))
    return s.groupBy(*keys).agg((F.sum(F.col("_x") * F.col("_ny") - F.col("_nx") * F.col("_y")) / 2).alias("area"))


def kernel_regression(queries: DataFrame, data: DataFrame, keys: list[str], sigma: float, reach: float = 8.0, err: bool = False) -> DataFrame:
    """keys, q, y: Gaussian-weighted means of data (keys, x, y) at every row's q; null where a key has no data.

    Weights are relative to that of the nearest datum, so a q far from all data has a mean too; those under
    exp(-reach ** 2 / 2), about 1e-14, of it do not count. What counts lies within ``reach`` sigmas of the
    places as far from q as the nearest datum, so the join is an equality on buckets. ``err`` adds sy: the
    weighted root mean square of the data's own residuals, over the root of one over the largest share.
    """
    one = queries.select(*keys, "q").distinct()
    found = _means(one, data, keys, sigma, reach)
    if err:
        own = _means(data.select(*keys, F.col("x").alias("q")).distinct(), data, keys, sigma, reach).select(*keys, F.col("q").alias("x"), F.col("y").alias("_m"))
        rest = data.join(own, [*keys, "x"]).select(*keys, "x", ((F.col("y") - F.col("_m")) ** 2).alias("y"))
        spread = _means(one, rest, keys, sigma, reach).select(*keys, "q", F.sqrt(F.col("y") * F.col("_share")).alias("sy"))
        found = found.join(spread, [*keys, "q"])
    return queries.select(*keys, "q").join(found.drop("_share"), [*keys, "q"], "left")


def _means(queries: DataFrame, data: DataFrame, keys: list[str], sigma: float, reach: float) -> DataFrame:
    """keys, q, y and the largest share of a datum, of distinct q."""
    width = reach * sigma
    # The distance to the nearest datum on either side, from running windows over both relations.
    marks = queries.select(*keys, F.col("q").cast("double").alias("_t"), F.lit(None).cast("double").alias("_x"))
    marks = marks.unionByName(data.select(*keys, F.col("x").cast("double").alias("_t"), F.col("x").cast("double").alias("_x")))
    w = Window.partitionBy(*keys).orderBy("_t")
    back = F.col("_t") - F.last("_x", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_x", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing)) - F.col("_t")
    near = marks.withColumn("_d", F.least(back, ahead)).where("_x IS NULL AND _d IS NOT NULL").select(*keys, F.col("_t").alias("q"), "_d")
    bucket = lambda c: F.floor(c / F.lit(width))
    places = F.array_distinct(F.array(*[bucket(F.col("q") + s * F.col("_d")) + k for s in (-1, 1) for k in (-1, 0, 1)]))
    left = near.withColumn("_b", F.explode(places))
    right = data.select(*keys, F.col("x").cast("double").alias("x"), "y").withColumn("_b", bucket(F.col("x")))
    gap = ((F.col("q") - F.col("x")) ** 2 - F.col("_d") ** 2) / F.lit(2 * sigma * sigma)
    both = left.join(right, [*keys, "_b"]).withColumn("_g", gap).where(F.col("_g") <= reach * reach / 2).withColumn("_w", F.exp(-F.col("_g")))
    return both.groupBy(*keys, "q").agg((F.sum(F.col("_w") * F.col("y")) / F.sum("_w")).alias("y"), (F.max("_w") / F.sum("_w")).alias("_share"))
