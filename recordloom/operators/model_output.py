"""Checks on tables that a model wrote, before they become groups, names or links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.coding import confidence_label_score
from ..functions.ranking import extreme_row
from ..functions.text import blank_to_null, named_id, norm_text
from ..session import ensure_checkpoint_dir
from .classify import name_bucket
from .grouping import bucket_agreement, leftover_groups, rejected_groups
from .records import record_bucket, visible
from .terminology import name_matches_source, safety_tokens

# Limits of names and reasons, thresholds and default confidences.
NAME_LENGTH, REASON_LENGTH, FALLBACK_BELOW = 80, 160, 0.55
DEFAULT_CONFIDENCE, FALLBACK_NAME_CONFIDENCE = 0.5, 0.45
NONE_TARGET = "__none__"


def clamp(c: Column, default: float = DEFAULT_CONFIDENCE) -> Column:
    return F.when(c.isNull(), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def parse_bucket(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return (
        F.when(dashed.isin("lab", "labs", "laboratory"), "labs")
        .when(dashed.isin("vital", "vitals", "vital-sign", "vital-signs"), "vitals")
        .when(dashed == "other", "other")
    )


def validate_groups(records: DataFrame, groups: DataFrame, members: DataFrame, fallback: DataFrame, fallback_members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model groups made safe, with the leftovers taken from ``fallback``.

    ``groups(patient_id, group_pos, group_id, name, bucket, confidence, reason, fallback)``, ``members(patient_id, group_pos, record_id)``.
    Unknown ids go, a record stays with the first group that names it, unsafe names are rejected, equal
    ids are merged. A patient without any accepted group keeps the fallback.
    """
    p = ["patient_id"]
    known = visible(records).select("patient_id", F.col("id").alias("record_id"), "resource_type", record_bucket(F.col("resource_type"), F.col("category"), F.col("category_code")).alias("_rb"))
    named = groups.filter("name is not null")
    key = named.withColumn("_gid", F.coalesce(blank_to_null(F.col("group_id")), named_id(F.col("name"))))
    offered = members.join(named.select(*p, "group_pos"), [*p, "group_pos"], "left_semi").join(known.select(*p, "record_id"), [*p, "record_id"], "left_semi").distinct()
    # A name the rule rejects frees its records for later groups, so rejection is decided on the offered members first.
    per_pos = offered.select(*p, F.col("group_pos").cast("string").alias("group_id"), "record_id")
    bad = rejected_groups(key.select(*p, F.col("group_pos").cast("string").alias("group_id"), "name"), per_pos, records).select(*p, F.col("group_id").cast("int").alias("group_pos"))
    safe = offered.join(bad, [*p, "group_pos"], "left_anti")
    owned = safe.groupBy(*p, "record_id").agg(F.min("group_pos").alias("group_pos"))
    rows = owned.join(key.select(*p, "group_pos", "_gid", "name", "bucket", "confidence", "reason", "fallback"), [*p, "group_pos"]).join(known, [*p, "record_id"])
    conf = clamp(F.col("confidence"))
    rows = rows.withColumns({"_c": conf, "_fb": F.coalesce("fallback", F.lit(False)) | (conf < FALLBACK_BELOW), "_b": F.coalesce(parse_bucket(F.col("bucket")), F.col("_rb"))})
    # Everything below looks at these assignments several times: they are computed once and saved.
    ensure_checkpoint_dir(records.sparkSession)
    rows = rows.checkpoint()
    first = F.min_by(F.struct("name", "reason"), "group_pos")
    merged = rows.groupBy(*p, "_gid").agg(
        first.alias("_f"), F.array_sort(F.collect_set("resource_type")).alias("resource_types"), F.min("_c").alias("confidence"), F.bool_or("_fb").alias("fallback"),
        bucket_agreement("_b").alias("_bucket"),
    )
    only_obs = (F.size("resource_types") == 1) & (F.element_at("resource_types", 1) == "Observation")
    accepted = merged.select(
        *p, F.col("_gid").alias("group_id"), F.substring("_f.name", 1, NAME_LENGTH).alias("name"), "resource_types", F.when(only_obs, F.col("_bucket")).alias("bucket"), "confidence",
        F.when(F.col("_f.reason").isNotNull(), F.substring("_f.reason", 1, REASON_LENGTH)).otherwise("Generated by local model.").alias("reason"), "fallback",
    )
    taken = rows.select(*p, F.col("_gid").alias("group_id"), "record_id")
    more, more_members = leftover_groups(records, fallback, fallback_members, taken, accepted.select(*p, "group_id"))
    served = accepted.select(*p).distinct()
    added = more.join(served, p, "left_semi")
    untouched = fallback.join(served, p, "left_anti").select(*accepted.columns)
    all_groups = accepted.unionByName(added).unionByName(untouched)
    all_members = (
        taken.unionByName(more_members.join(served, p, "left_semi")).unionByName(fallback_members.join(served, p, "left_anti").select(*p, "group_id", "record_id"))
    )
    return all_groups, all_members


# Shape of one item of a naming reply; the id may come under three names.
NAMING_ITEM = "struct<id:string,recordId:string,resourceId:string,patientFriendlyName:string,observationBucket:string,confidence:double,fallback:boolean>"


def naming_items(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Items of replies ``(batch_id, reply JSON)``: a list, or an object with items, results or records."""
    kind = f"array<{NAMING_ITEM}>"
    body = F.try_parse_json(reply)
    listed = F.coalesce(*[F.try_variant_get(body, path, kind) for path in ("$", "$.items", "$.results", "$.records")])
    rows = replies.select("batch_id", F.posexplode(listed).alias("item_pos", "_i"))
    return rows.select("batch_id", "item_pos", F.coalesce("_i.id", "_i.recordId", "_i.resourceId").alias("record_id"), F.col("_i.patientFriendlyName").alias("name"), F.col("_i.observationBucket").alias("bucket"), F.col("_i.confidence").alias("confidence"), F.col("_i.fallback").alias("fallback"))


def fallback_label() -> Column:
    return F.coalesce(blank_to_null(F.substring(F.trim("source_label"), 1, NAME_LENGTH)), F.col("resource_type"))


def validate_names(batches: DataFrame, items: DataFrame) -> DataFrame:
    """One name per expected record.

    ``batches(batch_id, record_id, resource_type, source_label, category, category_code, ingredients, code_texts, code_codings)``. A
    batch that misses a record or holds a nameless item falls back as a whole; a medication name must
    share a word with its source.
    """
    expected = batches.select("batch_id", "record_id")
    known = items.join(expected, ["batch_id", "record_id"], "left_semi")
    first = extreme_row(known, ["batch_id", "record_id"], ["item_pos"], "min").withColumn("_name", F.substring(F.trim("name"), 1, NAME_LENGTH))
    joined = safety_tokens(batches).join(first.select("batch_id", "record_id", "_name", "bucket", "confidence", F.col("fallback").alias("_fallback")), ["batch_id", "record_id"], "left")
    broken = joined.filter(F.nullif(F.col("_name"), F.lit("")).isNull()).select("batch_id").distinct().withColumn("_broken", F.lit(True))
    rows = joined.join(broken, "batch_id", "left")
    matches = (F.col("resource_type") != "MedicationRequest") | name_matches_source(F.col("_name"), F.col("_ingredient_tokens"), F.col("_source_tokens"))
    good = F.col("_broken").isNull() & matches
    own_bucket = F.when(F.col("resource_type") == "Observation", name_bucket(F.lit(None).cast("string"), F.col("category"), F.col("category_code")))
    return rows.select(
        "batch_id", "record_id", "resource_type",
        F.when(good, F.col("_name")).otherwise(fallback_label()).alias("name"),
        F.when(good, parse_bucket(F.col("bucket"))).otherwise(own_bucket).alias("bucket"),
        F.when(good, clamp(F.col("confidence"))).otherwise(FALLBACK_NAME_CONFIDENCE).alias("confidence"),
        F.when(good, F.coalesce("_fallback", F.lit(False))).otherwise(True).alias("fallback"),
    )


def association_items(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """First usable item per reply ``(patient_id, source_group, reply JSON)``: a name and a known label."""
    item = "struct<conditionName:string,confidence:string>"
    listed = F.try_variant_get(F.try_parse_json(reply), "$.associations", f"array<{item}>")
    usable = F.filter(
        F.transform(listed, lambda i: F.struct(F.trim(i["conditionName"]).alias("condition_name"), F.lower(F.trim(i["confidence"])).alias("label"))),
        lambda i: (i["condition_name"] != "") & i["label"].isin("high", "medium", "low"),
    )
    return replies.select("patient_id", "source_group", F.get(usable, F.lit(0)).alias("_i")).select("patient_id", "source_group", "_i.condition_name", "_i.label")


def validate_associations(items: DataFrame, choices: DataFrame, model: str, transform_version: int, now_ms: int) -> DataFrame:
    """Group edges for offered choices; a group without one gets an explicit ``none`` row.

    ``choices(patient_id, name, group_key, choice_pos)``; of equal names the first choice counts.
    """
    unique = choices.groupBy("patient_id", "name").agg(F.min_by("group_key", "choice_pos").alias("_target"))
    joined = items.join(unique.withColumnRenamed("name", "condition_name"), ["patient_id", "condition_name"], "left")
    hit = F.col("_target").isNotNull()
    return joined.select(
        "patient_id", "source_group",
        F.coalesce("_target", F.lit(NONE_TARGET)).alias("target_group"),
        F.lit("Observation").alias("source_type"), F.lit("Condition").alias("target_type"),
        F.when(hit, "monitoring_marker").otherwise("none").alias("relationship"),
        F.when(hit, confidence_label_score(F.col("label"))).otherwise(0.0).alias("confidence"),
        (~hit).alias("fallback"), F.lit(model).alias("model"), F.lit(transform_version).alias("transform_version"), F.lit(now_ms).cast("bigint").alias("updated_at"),
    )


def link_agreement(model_links: DataFrame, explicit_links: DataFrame) -> DataFrame:
    """Per source group: links of the model, explicit links, how many coincide, and whether they disagree."""
    m = model_links.filter(F.col("target_group") != NONE_TARGET).select("patient_id", "source_group", "target_group").distinct().withColumn("_m", F.lit(1))
    e = explicit_links.select("patient_id", "source_group", "target_group").distinct().withColumn("_e", F.lit(1))
    both = m.join(e, ["patient_id", "source_group", "target_group"], "full")
    agg = both.groupBy("patient_id", "source_group").agg(
        F.count("_m").alias("n_model"), F.count("_e").alias("n_explicit"), F.count_if(F.col("_m").isNotNull() & F.col("_e").isNotNull()).alias("n_shared")
    )
    return agg.withColumns({"matched": F.col("n_shared") > 0, "disagreed": (F.col("n_explicit") > 0) & (F.col("n_shared") == 0)})


def naming_key(name: Column, bucket: Column) -> Column:
    return F.concat(norm_text(name), F.lit("|"), F.coalesce(bucket, F.lit("")))
