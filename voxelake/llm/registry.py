"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelake.llm import ann, chat, decontam, exact, html_extract, langid, negatives, ngram_lm, packing, quality, repeats, simhash, tokencount
from voxelake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

PACK_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
COUNT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), PACK_VOCABULARY)


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_lm.scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(quality.graded(docs, table(spark, sf_dir, "labels")))
    return quality.judge(docs, model).select("doc_id", "quality.*")


def op5_language_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), COUNT_VOCABULARY)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"), label=negatives.moved_label()).drop("anchor_row")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.query(table(spark, sf_dir, "documents"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.search(table(spark, sf_dir, "embeddings")).drop("query_row")


def queries() -> dict[str, Query]:
    own = (
        op1_permutation_search,
        op2_best_fit_packing,
        op3_stupid_backoff,
        op4_ordinal_quality,
        op5_language_kneser_ney,
        op6_html_main_text,
        op7_simhash_classes,
        op8_decontamination,
        op9_quotation_links,
        op10_token_counts,
        op11_hard_negatives,
        op12_periodic_runs,
        op13_exact_top_k,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_stupid_backoff": ngram_lm.ORACLE,
        "op8_decontamination": decontam.ORACLE,
        "op9_quotation_links": chat.ORACLE,
        "op11_hard_negatives": negatives.ORACLE,
        "op13_exact_top_k": exact.ORACLE,
    }
