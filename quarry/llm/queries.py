"""Queries of this subpackage: each applies its operator to its whole table. oracles() holds SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.chat import chat_digest
from quarry.llm.extraction import extract_main_text
from quarry.llm.forest import hash_prefix_forest
from quarry.llm.language_id import identify_languages
from quarry.llm.media import media_digest
from quarry.llm.mixing import mix_sources
from quarry.llm.ngram_join import ngram_jaccard_join
from quarry.llm.quality import classify_quality
from quarry.llm.sentencepiece_lattice import encoding_digest
from quarry.llm.url_filter import judge_urls

#: The url rules (host, path, action).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A conversation whose texts look like control strings.
CONTROL_CASE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame(CONTROL_CASE, "conv_id long, turn long, role string, text string")
    return chat_digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digest(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hash_prefix_forest(vectors, vectors.where("vec_id % 20 = 0"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_chat_formatting, op2_html_extraction, op3_sentencepiece, op4_source_mixing, op5_ngram_jaccard_join, op6_nearest_neighbours, op7_media_columns, op8_language_id, op9_url_filters, op10_quality_classifier)
    return {f.__name__: f for f in found}


def oracles() -> dict[str, str]:
    """Every operator here is iterative, trained, or beyond SQL's reach on whole tables; tests/llm holds them against brute force."""
    return {}
