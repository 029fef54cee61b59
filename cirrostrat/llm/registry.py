"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, jaccard, language_id, licenses, packing, quality, spelling, toxicity, warc, wavelet

QUERIES = {
    "op9_jaccard": jaccard.query,
    "op5_packing": packing.query,
    "op8_token_files": wavelet.query,
    "op2_quality": quality.query,
    "op1_toxicity": toxicity.query,
    "op7_language_id": language_id.query,
    "op3_licenses": licenses.query,
    "op6_warc": warc.query,
    "op4_exact_dedup": exact_dedup.query,
    "op10_decontaminate": decontaminate.query,
    "op11_chat": chat.query,
    "op12_spelling": spelling.query,
}

ORACLE_SQL = {
    "op3_licenses": licenses.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_decontaminate": decontaminate.ORACLE_SQL,
    "op11_chat": chat.ORACLE_SQL,
    "op12_spelling": spelling.ORACLE_SQL,
}
