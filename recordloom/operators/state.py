"""Versioned cache tables: last-write-wins merges and completeness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ranking import extreme_row
from .records import known_category_bucket

# Models that name by rule, and the current version of each transform.
LOOKUP_MODEL, BM25_MODEL = "patient-friendly-lookup-v2", "bm25"
CLASSIFICATION_VERSIONS = {
    "AllergyIntolerance.classifyAllergy": 1,
    "Encounter.classifyClass": 1,
    "Encounter.classifyType": 1,
    "Observation.classifyCategory": 1,
}
ASSOCIATION_TRANSFORM, ASSOCIATION_VERSION = "ObservationGroup.associateConditionGroup", 13
GROUPING_KEY = ["compact_id"]
CLASSIFICATION_KEY = ["transform", "transform_version", "model", "compact_id"]
RELATIONSHIP_KEY = ["transform", "transform_version", "model", "source_group", "target_group"]


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """State with the newest row per key; a change beats a state row of the same order.

    An aggregate over the union: rows of a hot key are combined before the shuffle.
    """
    both = state.withColumn("_batch", F.lit(0)).unionByName(changes.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    cols = state.columns
    return extreme_row(both, keys, [*order, "_batch"]).select(*cols)


def last_write(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return extreme_row(rows, keys, order).select(*rows.columns)


def upsert_lookups(cache: DataFrame, lookups: DataFrame, order: list[str]) -> DataFrame:
    """Lookup results never replace an entry another model made."""
    taken = cache.filter(F.col("model") != LOOKUP_MODEL).select("compact_id")
    return upsert(cache, lookups.join(taken, "compact_id", "left_anti"), GROUPING_KEY, order)


def entry_complete(model_id: str | None = None, allow_lookup: bool = True) -> Column:
    """Whether a record joined to its cache entry (columns ``entry_type, model, bucket``) needs no more naming."""
    same = F.col("entry_type").isNotNull() & (F.col("entry_type") == F.col("resource_type"))
    by_rule = F.col("model").isin(LOOKUP_MODEL, BM25_MODEL)
    known = F.nullif(F.col("bucket"), F.lit("")).isNotNull() | known_category_bucket(F.col("resource_type"), F.col("category"), F.col("category_code")).isNotNull()
    ok = F.when(by_rule, F.lit(allow_lookup) & ((F.col("resource_type") != "Observation") | known))
    return F.coalesce(same & ok.otherwise(F.col("model") == model_id if model_id else F.lit(False)), F.lit(False))


def split_by_cache(concepts: DataFrame, cache: DataFrame, model_id: str | None = None, allow_lookup: bool = True) -> DataFrame:
    """Concepts with a ``cached`` flag."""
    entry = cache.select("compact_id", F.col("resource_type").alias("entry_type"), "model", "bucket")
    joined = concepts.join(entry, "compact_id", "left")
    return joined.withColumn("cached", entry_complete(model_id, allow_lookup)).drop("entry_type", "model", "bucket")


def coverage(rows: DataFrame, by: list[str], cached: str = "cached") -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(cached)).alias("n_cached"))
