"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that a link (a, b) names.

    Each round rewrites the links so that nodes point at ever smaller ones until only stars are left; it
    is written to the shared folder, so lineage stays short. Minima are partial aggregates, and a hub's
    links meet its minimum in a join that can be split. Rounds go on until one changes nothing; nodes only
    ever point at smaller ones, so that comes.
    """
    a, b = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = materialize(links.where("a <> b").select(a, b).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == state:
            break
        state = tuple(now)
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(linked.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
