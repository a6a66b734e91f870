"""Queries of the numbered operators and the pipeline, with SQL where it can express them."""

import corpus_pipeline
from tramline.llm import alignment, ann, katz, lexical_search, line_dedup, packing, piece_codec, quality_classifier, quality_rules, simhash, substring_dedup, token_files, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_toxicity": toxicity.op1_toxicity,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_lm_scoring": katz.op11_lm_scoring,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_alignment": alignment.op13_alignment,
    "op2_packing": packing.op2_packing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_token_files": token_files.op4_token_files,
    "op5_ann": ann.op5_ann,
    "op6_piece_codec": piece_codec.op6_piece_codec,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality_rules": quality_rules.op9_quality_rules,
}
ORACLE_SQL = {
    "op12_lexical_search": lexical_search.SQL,
    "op2_packing": packing.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op9_quality_rules": quality_rules.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
