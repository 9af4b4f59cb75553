"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; its result is written as Parquet to the shared folder and read again. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelake.llm import decontam, langid, packing, quality, simhash
from voxelake.llm.common import materialize, table
from voxelake.llm.registry import PACK_VOCABULARY

#: A fitted classifier and a tokenizer are no SQL: run() is tested against a brute-force version.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is not under one half.

    Null and empty texts get the grades' prior; ties at one half stay; with nothing
    rated everything stays; repeated rows are judged each.
    """
    return quality.keep_good(docs, quality.train(quality.graded(docs, table(spark, sf_dir, "labels"))))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: not rejected by the calibrated models.

    Null, empty and letterless texts go; with no language known everything goes;
    repeated rows are judged each.
    """
    return langid.keep_identified(docs, langid.train(docs))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of exact and near copies.

    Texts without words are copies of each other. Rows that repeat a doc_id go only if
    their texts are copies; rows without a doc_id are copies too, and stay where no copy
    has one.
    """
    return simhash.deduplicate(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window: each row is judged by its own text.

    Null and empty texts stay; an empty benchmark drops nothing.
    """
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences; null and empty texts are one end token."""
    return packing.pack(docs, PACK_VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("language", keep_identified),
    ("near_duplicates", keep_one_of_copies),
    ("decontamination", keep_uncontaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; rows as packing returns them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
