"""Registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, neardup, packing, quality, secrets, sharding, substring, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> dict[str, str]:
    return {
        "tokenizer": str(public_tokenizers.path("byte_bpe_50k.json")),
        "ranks": str(public_tokenizers.path("byte_bpe_50k.tiktoken")),
        "pattern": public_tokenizers.PATTERN,
    }


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("hit_spans")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).drop("text")


def page_document() -> Column:
    """The document a page shows: the last number in its url's path."""
    return F.expr(r"try_cast(regexp_extract(url, r'^[^?#]*?([0-9]+)[^0-9?#]*($|[?#])', 1) as bigint)")


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, bad): the label of the document that a page shows."""
    pages = table(spark, sf_dir, "pages").select("page_id", page_document().alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return pages.join(labels, "doc_id").select("page_id", "bad")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.filter_urls(table(spark, sf_dir, "pages"), page_labels(spark, sf_dir))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages, logs = language.fit(docs.select("doc_id", "text", "lang"), language.LanguageParams())
    evidence = language.page_evidence(table(spark, sf_dir, "pages"), page_document())
    return language.identify(docs, evidence, languages, logs)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = neardup.NearDupParams(shingle=3, percent=85)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), rules)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer_files())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_url_filters": op7_url_filters,
    "op8_language_id": op8_language_id,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_packing": op10_packing,
}
