"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage judges rows, not ids: rows may repeat an id or have none. A null text counts as an empty one. All stages read
whole texts, take an empty table for what it is, and keep columns of any further names; none depends on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrum.llm import exact_dedup, near_dedup, quality_cnn, quality_rules
from lodestrum.llm.common import Store, scope, table
from lodestrum.llm.packing import pack
from lodestrum.llm.queries import vocabulary


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that no quality rule rejects. Rows without words go; repeated rows share their verdict."""
    return quality_rules.keep_good(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the byte network scores one half or more, fitted on those documents of sf_dir that its labels cover, as
    the rules have left few bad ones to learn from. Without labels, or with those of one kind only, all rows stay or go
    alike. Repeated rows share their score."""
    return quality_cnn.keep_good(docs, table(spark, sf_dir, "labels"), taught_by=table(spark, sf_dir, "documents"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each text that is the same without white space: the one with the most code points, then the
    smallest id, a null id last; of rows that tie in both, one. Null and empty texts are one group."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of near copies, the one with the smallest id, a null id last; of equal ids the first
    row. Rows without words are near to nothing and stay."""
    return near_dedup.keep_first(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 2,048 tokens. A row without a text is its end token alone; rows that repeat are
    packed each for itself."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality_rules", rules_stage), ("quality_classifier", classifier_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("packing", packing_stage)]

#: SQL can't express the trained classifier, the sketches or the packing; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep. What a stage has stored goes once its result is written, and a result once
    the next one is."""
    docs, store = table(spark, sf_dir, "documents"), Store(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        with scope():
            result = store.put(stage(spark, docs, sf_dir), name)
        store.drop(docs)
        docs = result
    return STAGES[-1][1](spark, docs, sf_dir)
