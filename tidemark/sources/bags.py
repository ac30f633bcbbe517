"""Named DataFrames saved and loaded together, and build steps that run when their inputs are newer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(path: str, **frames: DataFrame) -> None:
    """One Parquet table for each name, and their order."""
    if not frames:
        raise ValueError("nothing to save")
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame(list(enumerate(frames)), "i int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_names")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    names = [r["name"] for r in spark.read.parquet(f"{path}/_names").orderBy("i").collect()]
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def load_views(spark: SparkSession, path: str) -> list[str]:
    """Every frame as a temporary view of its name."""
    frames = load(spark, path)
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return list(frames)


def modified(spark: SparkSession, path: str) -> int | None:
    """The newest modification under a path in milliseconds, by Spark's file system; None if there is nothing."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    status = fs.getFileStatus(p)
    if not status.isDirectory():
        return status.getModificationTime()
    newest, files = status.getModificationTime(), fs.listFiles(p, True)
    while files.hasNext():
        newest = max(newest, files.next().getModificationTime())
    return newest


def outdated(spark: SparkSession, target: str, *sources: str) -> bool:
    """No target, or a source that is newer."""
    have = modified(spark, target)
    return have is None or any((modified(spark, s) or 0) > have for s in sources)


def build(spark: SparkSession, target: str, sources: list[str], make: Callable[..., DataFrame]) -> bool:
    """make(*DataFrames of the sources), written to the target if outdated; whether it ran. Errors are raised."""
    if not outdated(spark, target, *sources):
        return False
    make(*[spark.read.parquet(s) for s in sources]).write.mode("overwrite").parquet(target)
    return True


def build_all(spark: SparkSession, targets: list[tuple[str, list[str]]], make: Callable[..., DataFrame]) -> list[bool]:
    """A step over many targets, in order."""
    return [build(spark, t, s, make) for t, s in targets]


def summary(df: DataFrame) -> DataFrame:
    """name, type, rows, nulls, distinct (approximate), low, high of each column: one aggregate."""
    basic = [f for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary", "variant")]
    aggs = [a for f in basic for a in (F.count_if(F.col(f"`{f.name}`").isNull()), F.approx_count_distinct(f"`{f.name}`"), F.min(f"`{f.name}`").cast("string"), F.max(f"`{f.name}`").cast("string"))]
    one = df.agg(F.count("*").alias("_n"), *[a.alias(f"_{k}") for k, a in enumerate(aggs)])
    rows = [F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.col("_n").alias("rows"), F.col(f"_{4 * k}").alias("nulls"), F.col(f"_{4 * k + 1}").alias("distinct"), F.col(f"_{4 * k + 2}").alias("low"), F.col(f"_{4 * k + 3}").alias("high")) for k, f in enumerate(basic)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
