"""The registered queries of this subpackage, and the DuckDB text of those that SQL can express."""

from __future__ import annotations

from culvert.llm import bpe, collocations, conversations, html_render, kneser_ney, line_rules, mixing, order_minhash, simhash, substrings, suffix_tree, threshold_topk, token_counts

QUERIES = {
    "op1_source_mixing": mixing.op1_source_mixing,
    "op2_suffix_tree_scores": suffix_tree.op2_suffix_tree_scores,
    "op3_line_rules": line_rules.op3_line_rules,
    "op4_threshold_topk": threshold_topk.op4_threshold_topk,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_bpe_round_trip": bpe.op6_bpe_round_trip,
    "op7_html_rendering": html_render.op7_html_rendering,
    "op8_simhash_components": simhash.op8_simhash_components,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_quality_classifier": kneser_ney.op10_quality_classifier,
    "op11_order_minhash": order_minhash.op11_order_minhash,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_phrase_collocations": collocations.op13_phrase_collocations,
}

ORACLE = {
    "op1_source_mixing": mixing.OP1_SQL,
    "op3_line_rules": line_rules.OP3_SQL,
    "op4_threshold_topk": threshold_topk.OP4_SQL,
    "op9_substring_dedup": substrings.OP9_SQL,
}
