"""Registered queries of this subpackage and the SQL that checks them, where SQL can."""

from . import crf, decontaminate, html_text, jaccard_join, mixture, quality_rules, secret_scan, token_counts, token_output, toxicity

QUERIES = {
    "op1_secret_scan": secret_scan.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_token_counts": token_counts.op3,
    "op4_decontaminate": decontaminate.op4,
    "op5_jaccard_join": jaccard_join.op5,
    "op6_mixture": mixture.op6,
    "op7_token_output": token_output.op7,
    "op8_language_crf": crf.op8,
    "op9_html_text": html_text.op9,
    "op10_toxicity": toxicity.op10,
}
ORACLE_SQL = {
    "op2_quality_rules": quality_rules.oracle_sql(),
    "op5_jaccard_join": jaccard_join.oracle_sql(),
}
