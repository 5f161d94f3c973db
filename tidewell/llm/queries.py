"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, lines, mixing, quality, sharding, simhash, tokens, toxicity, urls
from .oracles import ORACLE_SQL as ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_cut): every document without the lines that an earlier line of their group repeats."""
    return lines.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_cut")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages")).drop("regex_runs")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, section, n_chars, n_tokens): fields source, lang and text (head, body), and their separators."""
    return tokens.section_tokens(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(_table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, coverage, covered, n_tokens): every document that leaks an item, with the item."""
    return decontaminate.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "source", "copies")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_token_counts, op4_html_extraction, op5_decontamination, op6_simhash, op7_mixing, op8_quality_rules, op9_sharding, op10_toxicity)}
