"""The relations that the queries work on, made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, i, x: each user's values in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("k"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("value").alias("x"))


#: The same relation for the oracles.
SIGNALS = "s AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x FROM events)"


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, i, x: each embedding's components."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("k"), F.posexplode("embedding").alias("i", "x")).select("k", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


SPECTRA = "s AS (SELECT vec_id AS k, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def points(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """k, i, t: seconds of each user's events of a type; i is the event's id."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select(F.col("user_id").alias("k"), F.col("event_id").alias("i"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


def points_sql(name: str, kind: str) -> str:
    return f"{name} AS (SELECT user_id AS k, event_id AS i, epoch_us(ts) AS t FROM events WHERE event_type = '{kind}')"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, y, x, v: embeddings as 8 by 8 pictures of positive components."""
    s = spectra(spark, sf_dir)
    return s.select(F.col("k").alias("img"), F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), (F.col("x") > 0).cast("int").alias("v"))


IMAGES = SPECTRA + ", im AS (SELECT k AS img, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(x > 0 AS INTEGER) AS v FROM s)"


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o, l and a linear colour from each line of an order."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), (F.col("l_discount") * 10).alias("r"), (F.col("l_tax") * 12.5).alias("g"), (F.col("l_quantity") / 50).alias("b"))


COLORS = "c AS (SELECT l_orderkey AS o, l_linenumber AS l, l_discount * 10 AS r, l_tax * 12.5 AS g, l_quantity / 50 AS b FROM lineitem)"
