"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from loomgraph.llm import chat, decontam, divergence, fertility, language_id, line_dedup, masked_lm, mixing, near_dup, prefix_trie, quality, sharding, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_chat_formatting": chat.query,
    "op3_quality_classifier": quality.query,
    "op4_masked_lm_scoring": masked_lm.query,
    "op5_url_filter": url_filter.query,
    "op6_sharding": sharding.query,
    "op7_decontamination": decontam.query,
    "op8_fertility_rules": fertility.query,
    "op9_near_dedup": near_dup.query,
    "op10_source_mixing": mixing.query,
    "op11_language_id": language_id.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_source_divergence": divergence.query,
    # Operators 2 and 5 once more, over trees with branches and a table of redirects.
    "reply_trees": chat.tree_query,
    "url_aliases": url_filter.alias_query,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_chat_formatting": chat.SQL,
    "op5_url_filter": url_filter.SQL,
    "op9_near_dedup": near_dup.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_source_divergence": divergence.SQL,
    "reply_trees": chat.TREE_SQL,
    "url_aliases": url_filter.ALIAS_SQL,
}
