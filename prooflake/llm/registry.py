"""The training-data queries and the SQL that checks those which SQL can express."""

from __future__ import annotations

from prooflake.llm import audio_features, best_fit, byte_bpe, chat_collapse, compress_quality, conversation_repair, cross_polytope, prefix_trie, simhash, source_mix, suffix_dedup, token_counts, url_filter


def queries() -> dict:
    return {
        "op1_byte_bpe": byte_bpe.op1_byte_bpe,
        "op2_simhash": simhash.op2_simhash,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_source_mix": source_mix.op5_source_mix,
        "op6_audio_features": audio_features.op6_audio_features,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_cross_polytope": cross_polytope.op8_cross_polytope,
        "op9_chat_collapse": chat_collapse.op9_chat_collapse,
        "op10_compress_quality": compress_quality.op10_compress_quality,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_best_fit": best_fit.op12_best_fit,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_url_filter": url_filter.OP7_SQL,
        "op9_chat_collapse": chat_collapse.OP9_SQL,
    }
