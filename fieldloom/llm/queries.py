"""The registered queries of this subpackage and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import chat_format as _chat_format
from fieldloom.llm import decontaminate as _decontaminate
from fieldloom.llm import html_extract as _html_extract
from fieldloom.llm import language_id as _language_id
from fieldloom.llm import mixing as _mixing
from fieldloom.llm import near_duplicates as _near_duplicates
from fieldloom.llm import nearest_neighbours as _nearest_neighbours
from fieldloom.llm import oracles
from fieldloom.llm import recurrent_lm as _recurrent_lm
from fieldloom.llm import substring_dedup as _substring_dedup
from fieldloom.llm import url_filter as _url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chat_format.format_conversations(_table(spark, sf_dir, "conversations"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recurrent_lm.score_corpus(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language_id.identify_languages(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_duplicates.near_duplicate_components(_table(spark, sf_dir, "documents"), width=3, threshold="0.9")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mixing, op2_html_extraction, op3_url_filters, op4_chat_formatting, op5_lm_scoring, op6_language_id, op7_ngram_jaccard_join, op8_substring_dedup, op9_nearest_neighbours, op10_benchmark_decontamination)}


def oracle_sql() -> dict[str, str]:
    return oracles.ORACLES
