"""Queries of this package, by name, and their SQL oracles."""

from . import q_bpe, q_chat, q_decontaminate, q_langid, q_lm, q_neardup, q_pii, q_substrings, q_topk, q_toxicity

QUERIES = {
    "op1_decontaminate": q_decontaminate.op1_decontaminate,
    "op2_toxicity": q_toxicity.op2_toxicity,
    "op3_topk": q_topk.op3_topk,
    "op4_pii": q_pii.op4_pii,
    "op5_language_id": q_langid.op5_language_id,
    "op6_bpe": q_bpe.op6_bpe,
    "op7_lm_score": q_lm.op7_lm_score,
    "op8_suffix_dedup": q_substrings.op8_suffix_dedup,
    "op9_ngram_join": q_neardup.op9_ngram_join,
    "op10_chat_format": q_chat.op10_chat_format,
}
ORACLES = {"op3_topk": q_topk.SQL, "op10_chat_format": q_chat.SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
