"""Queries of the training-data operators and their SQL oracles."""

from . import embedding_dedup, exact_dedup, html_extraction, language_id, mixing, packing, simhash, substring_dedup, suffix_array, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_packing": packing.op4_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_language_id": language_id.op6_language_id,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_suffix_array": suffix_array.op9_suffix_array,
    "op10_html_extraction": html_extraction.op10_html_extraction,
}
SQL = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op7_embedding_dedup": embedding_dedup.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
}
