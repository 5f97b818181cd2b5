"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import decontamination, exact_dedup, mixing, pii_crf, quality_fm, simhash_dedup, token_counts, toxicity, url_rules, warc_index

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_pii": pii_crf.op3_pii,
    "op4_mixing": mixing.op4_mixing,
    "op5_url_filters": url_rules.op5_url_filters,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_simhash_dedup": simhash_dedup.op8_simhash_dedup,
    "op9_warc": warc_index.op9_warc,
    "op10_quality": quality_fm.op10_quality,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op5_url_filters": url_rules.ORACLE,
}
