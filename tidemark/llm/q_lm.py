"""Query op7: log10 probabilities of every document, learnt from nine tenths of them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod
from .lm import score


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(False))
    return score(docs, held, str(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN)
