"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chats, decontamination, fingerprints, licenses, oddsketch, quality, secrets, sharding, simhash, spelling, substrings, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@register("op1_benchmark_hits")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op3_site_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_bpe_codec")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_report(table(spark, sf_dir, "documents"))


@register("op5_hash_tree_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


@register("op6_scaled_sketches")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"), fingerprints.LEAST)


@register("op7_license_rules", licenses.license_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


@register("op8_simhash_groups")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates_report(table(spark, sf_dir, "documents"))


@register("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats_report(table(spark, sf_dir, "documents"))


@register("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(table(spark, sf_dir, "documents"))


@register("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_report(table(spark, sf_dir, "documents"))


@register("op12_chat_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.repair_report(table(spark, sf_dir, "conversations"))


@register("op13_odd_sketch_groups")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.duplicates_report(table(spark, sf_dir, "documents"))
