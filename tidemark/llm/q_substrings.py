"""Query op8: what stays of every document when repeated strings of 200 bytes go."""

from pyspark.sql import DataFrame, SparkSession

from .substrings import remove


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
