"""Queries opN_<name>: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.runtime import table

from .conversations import repair
from .decontaminate import contained_items
from .language import language_id
from .license_scan import license_scan
from .merkle import audited
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .packing import pack
from .quality import quality
from .quality import train as train_quality
from .sql import ORACLES
from .substring_dedup import substring_dedup
from .toxicity import toxicity
from .url_filter import filter_urls
from .url_filter import train as train_urls
from .warc import archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), train_urls(spark), threshold=0.5)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=80, shingle_words=5).drop("estimate")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, train_quality(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), min_words=50)


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), max_tokens=1024, tokenizer="byte_bpe_50k.json", end_id=2)


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"), damage=True)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"), every=3)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (op1_near_dedup, op2_license_scan, op3_warc, op4_decontaminate, op5_toxicity, op6_url_filter, op7_language_id, op8_mix_sources, op9_substring_dedup, op10_quality, op11_pack, op12_repair_conversations, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
