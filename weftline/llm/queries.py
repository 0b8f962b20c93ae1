"""Queries of the corpus operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from weftline.llm import chat_format, divergence, exact_dedup, licenses, mixing, near_dedup, packing, pii, secrets, suffix_dedup, topk, toxicity, whitening

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_topk": topk.op5_topk,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_secrets": secrets.op8_secrets,
    "op9_packing": packing.op9_packing,
    "op10_mixing": mixing.op10_mixing,
    "op11_whitening": whitening.op11_whitening,
    "op12_licenses": licenses.op12_licenses,
    "op13_divergence": divergence.op13_divergence,
}
ORACLE_SQL = {"op5_topk": topk.OP5_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL, "op13_divergence": divergence.OP13_SQL}
