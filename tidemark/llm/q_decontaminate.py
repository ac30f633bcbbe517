"""Query op1: the documents that hold a benchmark item, and which."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside
from .decontaminate import mark


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = mark(docs, items).select("doc_id", F.explode("hits").alias("h"))
    return hit.select("doc_id", "h.item_id", "h.coverage", "h.n_tiles")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold an item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own, back = aside(docs, ("hits",))
    return back(mark(own, items).where(F.size("hits") == 0).select(*own.columns))
