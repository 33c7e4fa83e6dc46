"""The registered queries of the corpus operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, line_dedup, lm_score, packing, quality, simhash, suffixes, toxicity, urls
from .common import documents


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, max_bits=4)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(documents(spark, sf_dir), size=50).drop("kept_text")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer or public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).drop("clean_text").withColumn("lost", F.round("lost", 9))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm_score.score(documents(spark, sf_dir))
    # sums of logarithms differ in their last digits with the order of their parts
    return rows.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(documents(spark, sf_dir), min_chars=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_neardup, op2_language_id, op3_suffix_dedup, op4_url_filter, op5_best_fit_packing,
        op6_decontamination, op7_quality_rules, op8_lm_score, op9_toxicity, op10_line_dedup,
    )
}
