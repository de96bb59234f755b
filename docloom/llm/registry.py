"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import chat_formatting, decontamination, fill_in_middle, fingerprints, html_extraction, jaccard_join, language_id, license_scan, line_dedup, phrases, sentencepiece_codec, toxicity, warc
from docloom.llm.common import read_table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": lambda s, d: language_id.op1_language_id(read_table(s, d, "documents")),
        "op2_jaccard_join": lambda s, d: jaccard_join.op2_jaccard_join(read_table(s, d, "documents")),
        "op3_sentencepiece": lambda s, d: sentencepiece_codec.op3_sentencepiece(read_table(s, d, "documents")),
        "op4_decontamination": lambda s, d: decontamination.op4_decontamination(read_table(s, d, "documents"), read_table(s, d, "benchmark")),
        "op6_toxicity": lambda s, d: toxicity.op6_toxicity(read_table(s, d, "documents"), read_table(s, d, "labels")),
        "op7_chat_formatting": lambda s, d: chat_formatting.op7_chat_formatting(read_table(s, d, "conversations")),
        "op8_license_scan": lambda s, d: license_scan.op8_license_scan(read_table(s, d, "documents")),
        "op9_fingerprints": lambda s, d: fingerprints.op9_fingerprints(read_table(s, d, "documents")),
        "op10_html_extraction": lambda s, d: html_extraction.op10_html_extraction(read_table(s, d, "pages")),
        "op5_line_dedup": lambda s, d: line_dedup.op5_line_dedup(read_table(s, d, "documents")),
        "op11_phrases": lambda s, d: phrases.op11_phrases(read_table(s, d, "documents")),
        "op12_warc": lambda s, d: warc.op12_warc(read_table(s, d, "pages")),
        "op13_fill_in_middle": lambda s, d: fill_in_middle.op13_fill_in_middle(read_table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": decontamination.OP4_SQL,
        "op5_line_dedup": line_dedup.OP5_SQL,
        "op7_chat_formatting": chat_formatting.OP7_SQL,
        "op11_phrases": phrases.OP11_SQL,
        "op12_warc": warc.OP12_SQL,
        "op13_fill_in_middle": fill_in_middle.OP13_SQL,
    }
