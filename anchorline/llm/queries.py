"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate,
    fingerprints,
    jaccard,
    language,
    licenses,
    lm,
    neardup,
    packing,
    runs,
    search,
    sharding,
    substrings,
    suffixes,
)
from .common import table


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op5_winnowed_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op6_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op7_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


def op8_interval_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(spark, sf_dir, "documents"))


def op9_bayesian_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"))


def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(table(spark, sf_dir, "documents"))


def op10_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word form of the tenth operator; the entry registers it beside the byte form that SQL fixes."""
    return lm.word_report(table(spark, sf_dir, "documents"))


def op11_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(table(spark, sf_dir, "documents"))


def op12_tiled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"))


def op13_blocked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_syncmer_fingerprints,
        op2_best_two_fit,
        op3_wu_manber,
        op4_super_kmers,
        op5_winnowed_licenses,
        op6_byte_gru,
        op7_differencing,
        op8_interval_tree,
        op9_bayesian_minhash,
        op10_stupid_backoff,
        op11_prefix_join,
        op12_tiled_runs,
        op13_blocked_search,
    ]
    return {query.__name__: query for query in found}
