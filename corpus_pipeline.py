"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, packing.

Each stage works on all rows that the one before kept. All but the last
return the columns of ``documents``, and any others that came with them, whatever
their names; the last returns packed pieces. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rangeflow.llm import decontaminate, neardup, packing, quality, secrets
from rangeflow.llm.queries import table, tokenizer_files
from rangeflow.llm.shared import cut, mark, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts among them. Null ids and repeated rows are rows like others."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more.

    It is the one with the smallest id. Texts without words are groups of their own; a row that repeats
    id and text stays once; rows without an id are not compared and stay.
    """
    return neardup.keep_first(docs, neardup.NearDupParams(shingle=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of any benchmark item go. Null and empty texts, null ids and repeated rows stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), least_items=1)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and ``n_chars`` follows; all documents stay, null and empty texts unchanged."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of binary length; a null or empty text is its end token alone, repeated rows have pieces of their own."""
    return packing.pack(docs, **tokenizer_files())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: SQL has neither zstandard nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    start = mark()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        release(start, keep=1)  # with what the stage before kept
    return STAGES[-1][1](spark, docs, sf_dir)
