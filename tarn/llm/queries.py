"""Queries and oracle SQL of the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import ctw, decontam, extract, fingerprint, langid, pieces, sharding, simhash, substring, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": pieces.op1,
        "op2_fingerprints": fingerprint.op2,
        "op3_language_id": langid.op3,
        "op4_rendezvous_shards": sharding.op4,
        "op5_decontamination": decontam.op5,
        "op6_context_tree": ctw.op6,
        "op7_warc": warc.op7,
        "op8_html_extraction": extract.op8,
        "op9_substring_dedup": substring.op9,
        "op10_simhash_near_dedup": simhash.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_rendezvous_shards": sharding.OP4_SQL,
        "op5_decontamination": decontam.OP5_SQL,
        "op7_warc": warc.OP7_SQL,
        "op9_substring_dedup": substring.OP9_SQL,
    }
