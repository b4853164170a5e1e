"""The queries of the corpus operators and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat, exact_dedup, jaccard, packing, pii, quality, substring_dedup, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
        "op2_byte_bpe": byte_bpe.op2_byte_bpe,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_pii": pii.op4_pii,
        "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_warc": warc.op9_warc,
        "op10_quality_rules": quality.op10_quality_rules,
        # columns of op4 and op10 that SQL can express
        "base_spans_of_op4": pii.base_counts,
        "base_rules_of_op10": quality.base_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": jaccard.OP1_SQL,
        "op3_substring_dedup": substring_dedup.OP3_SQL,
        "op5_chat_formatting": chat.OP5_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op9_warc": warc.OP9_SQL,
        "base_spans_of_op4": pii.BASE_SQL,
        "base_rules_of_op10": quality.BASE_SQL,
    }
