"""Query op5: the language of every document, learnt from four fifths of them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, crc_mod
from .langid import classify, fit


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs.select("doc_id", "text", "lang"), ~held)
    out = classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is rejected go."""
    own, back = aside(docs, ("lang_pred", "score", "rejected"))
    kept = classify(own, fit(docs.select("doc_id", "text", "lang"), F.lit(True)))
    return back(kept.where(~F.col("rejected")).select(*own.columns))
