"""From raw documents to encoded training data: five stages, each on all that its predecessor kept.

1. language: documents whose language is rejected go.
2. near_duplicates: of each group of near copies one document stays.
3. benchmark: documents that hold a benchmark item go.
4. personal_data: spans of personal data become the names of their kinds.
5. encode: texts become token ids; the rows are counts and digests.

The stages involve compression, tiling and message passing, so SQL has no form of them; tests hold each
stage against brute force.

Defined cases: null and empty texts have no language and go in the first stage; so do texts whose two best
languages tie. Repeated rows become one in the second. Null ids, languages and sources are kept; texts of any
length go through whole; extra columns, whatever their names, go through the stages but the last; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import materialize
from tidemark.llm.q_bpe import stage_bpe
from tidemark.llm.q_decontaminate import stage_decontaminate
from tidemark.llm.q_langid import stage_language
from tidemark.llm.q_neardup import stage_neardup
from tidemark.llm.q_pii import stage_pii

STAGES = [
    ("language", stage_language),
    ("near_duplicates", stage_neardup),
    ("benchmark", stage_decontaminate),
    ("personal_data", stage_pii),
    ("encode", stage_bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
