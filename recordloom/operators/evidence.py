"""What the members of a group say about it: evidence for links between groups, and the filters of lists.

``members`` are records with the key columns of their group. Members stay rows: every rule is one partial aggregation
over the members and one join with the groups, so no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import classify
from .grouping import group_status
from .records import bucket_from_category, kind_is_active, relationship_eligible

RXNORM = "rxnorm:"


def observed_groups(groups: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Observation groups that a completed member vouches for, with ``is_lab``: its bucket says so, or such a member is classed as a lab.

    Both kinds are linked by their code, labs first; a group without a completed member is linked to nothing.
    """
    label = classify.classify_observation(F.col("category"), F.col("category_code"), classify.concept_words())["label"]
    told = relationship_eligible(members).groupBy(*keys).agg(F.bool_or(label == "labs").alias("_lab"))
    own = groups.filter("resource_type = 'Observation'").join(told, keys)
    return own.withColumn("is_lab", F.coalesce(F.col("bucket") == "labs", F.lit(False)) | F.col("_lab")).drop("_lab")


def medication_codes(groups: DataFrame, members: DataFrame, keys: list[str], own_code: str = "canonical_code") -> DataFrame:
    """``(keys, code)``: the product codes of a group's visible members, or the group's own code where they have none."""
    shown = members.filter(~F.coalesce("hidden", F.lit(False)) & (F.col("resource_type") == "MedicationRequest"))
    coded = F.filter(F.coalesce("coding_keys", F.array().cast("array<string>")), lambda k: k.startswith(RXNORM))
    codes = shown.select(*keys, F.explode_outer(coded).alias("_k")).select(*keys, F.substring("_k", F.lit(len(RXNORM) + 1), F.length("_k")).alias("code")).distinct()
    with_codes = codes.filter("code is not null")
    without = codes.groupBy(*keys).agg(F.count("code").alias("_n")).filter("_n = 0").drop("_n")
    own = groups.join(without, keys, "left_semi").select(*keys, F.col(own_code).alias("code")).filter("code is not null")
    return with_codes.join(groups.select(*keys), keys, "left_semi").unionByName(own)


def active_groups(members: DataFrame, keys: list[str], superseded: DataFrame) -> DataFrame:
    """Keys of the groups that an active filter keeps: an active status, and no member whose denial of an allergy a specific one contradicts.

    ``superseded(patient_id, id)`` names such records, as ``classify.superseded_negatives`` gives them.
    """
    rolled = group_status(members, keys).filter(kind_is_active(F.col("status_kind"))).select(*keys)
    denied = members.filter("resource_type = 'AllergyIntolerance'").join(superseded.select("patient_id", "id"), ["patient_id", "id"], "left_semi")
    return rolled.join(denied.select(*keys).distinct(), keys, "left_anti")


def shown_bucket(label: Column | None = None) -> Column:
    """The bucket an observation is listed in: a class that says something, else its category, else ``other``."""
    stated = bucket_from_category(F.col("category"), F.col("category_code"))
    known = F.nullif(label, F.lit("unknown")) if label is not None else F.lit(None).cast("string")
    return F.coalesce(known, stated, F.lit("other"))


def filter_records(
    records: DataFrame, bucket: str | None = None, visit_class: str | None = None, sources: list[str] | None = None, types: list[str] | None = None, chosen_class: Column | None = None
) -> DataFrame:
    """Records of a list under its filters; a bucket only concerns observations and a visit class only visits."""
    out = records
    if types is not None:
        out = out.filter(F.col("resource_type").isin(*types))
    if sources is not None:
        out = out.filter(F.col("source_id").isin(*sources))
    words = classify.concept_words()
    if bucket is not None:
        label = classify.classify_observation(F.col("category"), F.col("category_code"), words)["label"]
        out = out.filter((F.col("resource_type") != "Observation") | (shown_bucket(label) == bucket))
    if visit_class is not None:
        own = classify.classify_visit(words)["label"]
        label = own if chosen_class is None else F.coalesce(chosen_class, own)
        out = out.filter((F.col("resource_type") != "Encounter") | (label == visit_class))
    return out
