"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from tidemark.llm import align, chat, decontaminate, html_main, linededup, mixing, neardup, pii, quality, repair, secrets, topk, warc


def queries() -> dict:
    return {
        "op1_pii_spans": pii.op1,
        "op2_warc_round_trip": warc.op2,
        "op3_preference_format": chat.op3,
        "op4_decontaminate": decontaminate.op4,
        "op5_mix_sources": mixing.op5,
        "op6_near_duplicates": neardup.op6,
        "op7_main_text": html_main.op7,
        "op8_secret_scan": secrets.op8,
        "op9_line_dedup": linededup.op9,
        "op10_quality_forest": quality.op10,
        "op11_repair_conversations": repair.op11,
        "op12_pivot_top_k": topk.op12,
        "op13_align_tokens": align.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_round_trip": warc.OP2_SQL,
        "op3_preference_format": chat.OP3_SQL,
        "op4_decontaminate": decontaminate.OP4_SQL,
        "op5_mix_sources": mixing.OP5_SQL,
        "op6_near_duplicates": neardup.OP6_SQL,
        "op9_line_dedup": linededup.OP9_SQL,
        "op11_repair_conversations": repair.OP11_SQL,
        "op12_pivot_top_k": topk.OP12_SQL,
    }
