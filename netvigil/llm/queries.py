"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netvigil.llm import chat, decontam, divergence, fim, html, huffman, license, neighbours, packing, ppm, simhash, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_simhash": simhash.op2_simhash,
    "op3_extract": html.op3_extract,
    "op4_nearest": neighbours.op4_nearest,
    "op5_decontaminate": decontam.op5_decontaminate,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_suffix_dedup": substrings.op7_suffix_dedup,
    "op8_chat_format": chat.op8_chat_format,
    "op9_license_scan": license.op9_license_scan,
    "op10_token_output": huffman.op10_token_output,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_lm_score": ppm.op12_lm_score,
    "op13_divergence": divergence.op13_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op8_chat_format": chat.OP8_SQL,
    "op9_license_scan": license.OP9_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
