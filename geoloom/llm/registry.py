"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import bpe, chat, langid, lm, matroska, mixing, ngram_join, quality, secrets, tokenstore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_language_id": langid.op2_language_id,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_media_columns": matroska.op5_media_columns,
    "op6_lm_score": lm.op6_lm_score,
    "op7_token_store": tokenstore.op7_token_store,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_chat_format": chat.op10_chat_format,
}
ORACLES: dict[str, str] = {
    "op3_quality_rules": quality.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op10_chat_format": chat.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
