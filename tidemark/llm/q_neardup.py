"""Query op9: components of documents whose sets of 4-word shingles overlap by 85 % or more."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside
from .neardup import join


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of 5-word shingles at 0.8, the document with the smallest id stays.

    Rows go by their ids: repeats of a row become one, different texts under one id stay or go together, and
    rows without an id, which nothing can be said about, stay.
    """
    own, back = aside(docs, ("_same",))
    found = join(docs.select("doc_id", "text"), words=5, percent=80)
    kept = found.where("doc_id = component_id OR component_id IS NULL").select("doc_id").distinct()
    rows = own.join(kept, own["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
    rows = rows.withColumn("_same", F.xxhash64("text")).dropDuplicates(["doc_id", "_same"]).drop("_same")
    return back(rows)

