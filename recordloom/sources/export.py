"""Lookback filter, collection bundles and the payload-size gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import json_fields as J
from ..functions.dates import MS_PER_DAY, millis

# Types that are cut by the lookback, and where their date is looked for.
HIGH_VOLUME_TYPES = ("Observation", "DiagnosticReport", "DocumentReference", "Encounter", "Procedure", "Immunization")
DATE_FIELDS = ("effectiveDateTime", "issued", "date", "created", "performedDateTime", "occurrenceDateTime", "onsetDateTime", "recordedDate")
PERIOD_FIELDS = ("effectivePeriod", "period", "performedPeriod")
MAX_PAYLOAD_BYTES = 1800


def resource_date(body: Column) -> Column:
    return F.coalesce(*[J.text(body, f) for f in DATE_FIELDS], *[J.period_start(body, f) for f in PERIOD_FIELDS])


def lookback_keeps(resource_type: Column, date: Column, lookback_days: int | None, now_ms: int) -> Column:
    """Old rows of high-volume types go; undated or unreadable dates stay."""
    if not lookback_days:
        return F.lit(True)
    at = millis(date)
    return ~resource_type.isin(*HIGH_VOLUME_TYPES) | at.isNull() | (at >= F.lit(now_ms - lookback_days * MS_PER_DAY))


def filter_lookback(resources: DataFrame, lookback_days: int | None, now_ms: int) -> DataFrame:
    return resources.filter(lookback_keeps(F.col("resource_type"), resource_date(F.col("body")), lookback_days, now_ms))


def collection_entries(resources: DataFrame, patches: DataFrame) -> DataFrame:
    """Bundle entries: the resources, then the patches whose target is among them.

    Both sides grow with the records, while Spark would judge them by the size of packed files: they are sorted, never broadcast.
    """
    shown = resources.filter("id is not null").select("patient_id", F.col("resource_type").alias("target_type"), F.col("id").alias("target_id"))
    kept = patches.join(shown.hint("merge"), ["patient_id", "target_type", "target_id"], "left_semi")
    of_resources = resources.select(
        "patient_id",
        F.concat_ws("/", "resource_type", "id").alias("full_url"),
        F.to_json("body").alias("resource"),
    )
    of_patches = kept.select(
        "patient_id",
        F.concat(F.lit("PatientPatch/"), "patch_id").alias("full_url"),
        F.to_json(
            F.struct(
                F.col("patch_id").alias("id"),
                F.col("target_type").alias("targetResourceType"),
                F.col("target_id").alias("targetResourceId"),
                "field",
                "value",
                F.col("authored_at").alias("authoredAt"),
            )
        ).alias("resource"),
    )
    return of_resources.unionByName(of_patches)


def write_collections(entries: DataFrame, path: str, buckets: int = 256) -> None:
    """JSON lines of bundle entries in a bounded number of patient buckets.

    A folder per patient would make as many folders as patients; a bucket holds many patients and a
    hot patient is still written by many tasks.
    """
    placed = entries.withColumn("bucket", F.pmod(F.xxhash64("patient_id"), F.lit(buckets)).cast("int"))
    placed.write.mode("overwrite").partitionBy("bucket").json(path)


def payload_bytes(value: Column) -> Column:
    return F.octet_length(F.to_json(value))


def payload_fits(value: Column, limit: int = MAX_PAYLOAD_BYTES) -> Column:
    return payload_bytes(value) <= limit
