"""Query op6: encodes and decodes every document with a public byte-level vocabulary."""

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, vocabulary(), digest=True).drop("text")


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the encoded texts, and digests that show the round trip."""
    return encode(docs.select("doc_id", "text"), vocabulary(), digest=True).drop("text")
