"""From raw documents to token ids: identify the language, apply quality rules, drop near copies, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import langid, minhash, mixing, pieces, quality
from seqloom.llm.common import discard, staged, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; texts without a letter and texts of mostly unknown 3-grams go."""
    return langid.keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger passes."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights; one row per epoch a document is taken in."""
    return mixing.mixed(docs, whole_rows=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's whole text."""
    return pieces.token_report(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("sentencepiece", encode),
]
#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written to the shared folder, read by the next and then deleted."""
    docs = table(spark, sf_dir, "documents")
    before = []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
