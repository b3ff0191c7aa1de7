"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import huffman, lz, mixing, packing, pii, quality, simhash, suffix, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": suffix.op1_suffix_array_dedup,
        "op2_packing": packing.op2_packing,
        "op3_pii_surrogates": pii.op3_pii_surrogates,
        "op4_warc": warc.op4_warc,
        "op5_token_ids": huffman.op5_token_ids,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_mixing": mixing.op7_mixing,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
        "op10_lz_fingerprint": lz.op10_lz_fingerprint,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array_dedup": suffix.ORACLE,
        "op4_warc": warc.ORACLE,
        "op9_simhash_near_dedup": simhash.ORACLE,
    }
