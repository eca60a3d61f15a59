"""The operators as registered queries over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm import bpe_codec, chat, decontaminate, divergence, license_templates, line_windows, merkle, multi_index, pfair, quality, simhash, token_prefix, toxicity


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf, "documents"))


def op4_chat(spark: SparkSession, sf: str) -> DataFrame:
    text = f"{chat.END}{chat.START}assistant ok"
    more = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role")
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_rows(rows.unionByName(more.withColumn("text", F.lit(text)))))


def op5_line_windows(spark: SparkSession, sf: str) -> DataFrame:
    return line_windows.line_report(_table(spark, sf, "documents"))


def op6_bpe_codec(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_codec.digests(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    return multi_index.neighbours(_table(spark, sf, "embeddings"))


def op3_license_templates(spark: SparkSession, sf: str) -> DataFrame:
    return license_templates.scan(_table(spark, sf, "documents"))


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(_table(spark, sf, "documents"))


def op8_token_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return token_prefix.token_counts(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_pfair_mix(spark: SparkSession, sf: str) -> DataFrame:
    placed = pfair.mixed(_table(spark, sf, "documents"))
    return placed.select("doc_id", "source", "rank", "share", "slot")


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.audit(_table(spark, sf, "documents"))


def op12_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op13_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(_table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_multi_index": op2_multi_index,
    "op3_license_templates": op3_license_templates,
    "op4_chat": op4_chat,
    "op5_line_windows": op5_line_windows,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_quality": op7_quality,
    "op8_token_prefix": op8_token_prefix,
    "op9_pfair_mix": op9_pfair_mix,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_decontaminate": op12_decontaminate,
    "op13_divergence": op13_divergence,
}

ORACLE: dict[str, str] = {
    "op3_license_templates": license_templates.sql(),
    "op4_chat": chat.SQL,
    "op5_line_windows": line_windows.SQL,
    "op7_quality": quality.SQL,
    "op9_pfair_mix": pfair.SQL,
    "op11_merkle": merkle.SQL,
    "op12_decontaminate": decontaminate.SQL,
    "op13_divergence": divergence.SQL,
}
