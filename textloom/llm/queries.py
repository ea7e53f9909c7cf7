"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from . import op1_warc, op2_token_store, op3_run_index, op4_embedding_forest, op5_quality_classifier, op6_mixing, op7_ngram_join, op8_quality_rules, op9_packing, op10_line_dedup

QUERIES = {
    "op1_warc": op1_warc.op1_warc,
    "op2_token_store": op2_token_store.op2_token_store,
    "op3_run_index": op3_run_index.op3_run_index,
    "op4_embedding_forest": op4_embedding_forest.op4_embedding_forest,
    "op5_quality_classifier": op5_quality_classifier.op5_quality_classifier,
    "op6_mixing_sources": op6_mixing.op6_mixing_sources,
    "op7_ngram_join": op7_ngram_join.op7_ngram_join,
    "op8_quality_rules": op8_quality_rules.op8_quality_rules,
    "op9_best_fit_packing": op9_packing.op9_best_fit_packing,
    "op10_line_dedup": op10_line_dedup.op10_line_dedup,
}

ORACLE_SQL = {"op1_warc": op1_warc.ORACLE, "op8_quality_rules": op8_quality_rules.ORACLE, "op10_line_dedup": op10_line_dedup.ORACLE}
