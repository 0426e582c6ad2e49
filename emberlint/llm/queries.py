"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from emberlint.llm import counts, decontam, htmltext, manifest, neardup, oracle, packing, pii, quality, retention, substring, tokens, toxicity, urlfilter

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_decontamination": decontam.op2,
    "op3_token_files": tokens.op3,
    "op4_html_text": htmltext.op4,
    "op5_quality": quality.op5,
    "op6_best_fit_packing": packing.op6,
    "op7_near_duplicates": neardup.op7,
    "op8_substring_dedup": substring.op8,
    "op9_token_counts": counts.op9,
    "op10_pii": pii.op10,
    "op11_retention": retention.op11,
    "op12_url_filter": urlfilter.op12,
    "op13_manifest": manifest.op13,
}
ORACLE_SQL = {
    "op2_decontamination": oracle.OP2_SQL,
    "op5_quality": quality.OP5_SQL,
    "op7_near_duplicates": oracle.OP7_SQL,
    "op8_substring_dedup": oracle.OP8_SQL,
    "op11_retention": retention.OP11_SQL,
    "op12_url_filter": urlfilter.OP12_SQL,
    "op13_manifest": manifest.OP13_SQL,
}
