"""Query op10: formats all conversations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import canonical_turns, masked_text, read_back, render

#: Fixed value: the conversation that the contract adds.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def digest(rows: DataFrame) -> DataFrame:
    out = render(canonical_turns(rows)).withColumn("back", read_back(F.col("formatted")))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = masked_text(F.col("formatted"), F.col("loss_mask"))
    out = out.select("conv_id", "formatted", F.size("back").cast("long").alias("n_turns"), lines.alias("lines"), loss.alias("loss"))
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("lines").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return digest(rows.unionByName(extra))


def _count(s: str) -> str:
    return f"((length(x) - length(replace(x, '{s}', ''))) // {len(s)})"


_EXTRA = "length(x) + (length(x) - length(replace(x, chr(92), ''))) + " + " + ".join(_count(s) for s in ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))

SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, {_EXTRA.replace('x', 'role')} AS role_len, {_EXTRA.replace('x', 'text')} AS text_len FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(role_len + text_len + 9 + 7 + 7) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
