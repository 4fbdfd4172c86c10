"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, line_dedup, mixing, quality, rules, sentencepieces, simhash, token_counts, token_files, toxicity

QUERIES = {
    "op1_scann": ann.op1_scann,
    "op2_quality": quality.op2_quality,
    "op3_rules": rules.op3_rules,
    "op4_tokens": token_counts.op4_tokens,
    "op5_sentencepiece": sentencepieces.op5_sentencepiece,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_token_files": token_files.op7_token_files,
    "op8_simhash": simhash.op8_simhash,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixing": mixing.op10_mixing,
}

ORACLE_SQL = {
    "op1_scann": ann.OP1_SQL,
    "op3_rules": rules.OP3_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
