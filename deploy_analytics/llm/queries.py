"""Queries of this subpackage on the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, chat, collocation, exact_dedup, license_scan, line_dedup, lm_score, merkle, near_dedup, packing, secret_scan, toxicity, variants

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op8_toxicity": toxicity.op8_toxicity,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_fingerprints": merkle.op4_fingerprints,
    "op5_license_scan": license_scan.op5_license_scan,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_spelling_variants": variants.op11_spelling_variants,
    "op12_chat_formatting": chat.op12_chat_formatting,
    "op13_collocations": collocation.op13_collocations,
}

ORACLE_SQL = {
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op12_chat_formatting": chat.ORACLE,
    "op13_collocations": collocation.ORACLE,
}
