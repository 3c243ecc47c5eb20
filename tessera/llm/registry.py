"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from tessera.llm import chat, decontaminate, fingerprint, language, licenses, maxent, neardup, packing, quality, secrets

QUERIES = {
    "op4_lm_score": maxent.op4_lm_score,
    "op2_quality": quality.op2_quality,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op5_licenses": licenses.op5_licenses,
    "op9_chat": chat.op9_chat,
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op7_secrets": secrets.op7_secrets,
    "op8_packing": packing.op8_packing,
    "op10_language": language.op10_language,
    "op6_decontamination": decontaminate.op6_decontamination,
}
SQL = {
    "op5_licenses": licenses.OP5_SQL,
    "op3_near_duplicates": neardup.OP3_SQL,
    "op9_chat": chat.OP9_SQL,
    "op6_decontamination": decontaminate.OP6_SQL,
}
