"""The queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from ledgerlens.llm import bpe, chat, decontaminate, exact_dedup, html_extract, line_dedup, merkle, quality, repair, sharding, simhash, token_count, token_files

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_chat_format": chat.op5_chat_format,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_token_count": token_count.op9_token_count,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_sharding": sharding.op12_sharding,
    "op13_conversation_repair": repair.op13_conversation_repair,
}

ORACLE = {
    "op2_line_dedup": line_dedup.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_sharding": sharding.SQL,
    "op13_conversation_repair": repair.SQL,
}
