"""The operators of this folder as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailscope.llm import (
    chat_format, cover_tree, divergence, filter_audit, langid, mixing, oracle, packing, quality, secret_scan, sharding, simhash, simple8b, warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(_table(spark, sf_dir, "embeddings"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data: what the formatted conversations teach bears loss, and all three limits bind."""
    return packing.pack_conversations(chat_format.format_conversations(_table(spark, sf_dir, "conversations")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_and_digest(chat_format.with_control(_table(spark, sf_dir, "conversations")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_top_k": op3_top_k,
    "op4_langid": op4_langid,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_simple8b": op7_simple8b,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "pack_conversations": pack_conversations,
    "op10_secrets": op10_secrets,
    "op11_chat_format": op11_chat_format,
    "op12_filter_audit": op12_filter_audit,
    "op13_divergence": op13_divergence,
}

ORACLE: dict[str, str] = oracle.STATEMENTS
