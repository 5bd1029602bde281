"""Registered queries of this subpackage and their SQL."""

from quaestor.llm import chat, clustering, decontaminate, forest, jaccard, langid, lm, mixing, quality, substring, tokencounts, tokenfiles, trie

QUERIES = {
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op8_token_counts": tokencounts.op8_token_counts,
    "op3_token_files": tokenfiles.op3_token_files,
    "op4_language_id": langid.op4_language_id,
    "op7_lm_scoring": lm.op7_lm_scoring,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_quality_rules": quality.op6_quality_rules,
    "op10_source_mixing": mixing.op10_source_mixing,
    "op11_embedding_near_dedup": forest.op11_embedding_near_dedup,
    "op12_centroid_clustering": clustering.op12_centroid_clustering,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
ORACLES = {
    "op9_jaccard_join": jaccard.SQL,
    "op1_substring_dedup": substring.SQL,
    "op5_benchmark_decontamination": decontaminate.SQL,
    "op6_quality_rules": quality.SQL,
    "op10_source_mixing": mixing.SQL,
    "op11_embedding_near_dedup": forest.SQL,
    "op12_centroid_clustering": clustering.SQL,
    "op13_prefix_trie": trie.SQL,
}
