"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, chat, lines, lm, mixing, pivots, quality, simhash, suffix, topk

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_byte_bpe": bpe.query,
    "op3_lm_score": lm.query,
    "op4_suffix_dedup": suffix.query,
    "op5_top_k": topk.query,
    "op6_simhash": simhash.query,
    "op7_chat_rotation": chat.query,
    "op8_pivot_dedup": pivots.query,
    "op9_quality": quality.query,
    "op10_line_dedup": lines.query,
}

SQL: dict[str, str] = {
    "op1_mix_sources": mixing.SQL,
    "op4_suffix_dedup": suffix.SQL,
    "op5_top_k": topk.SQL,
    "op7_chat_rotation": chat.SQL,
}
