"""Compaction and grouping of records under one name.

Groups are kept relational: one row per group, and one row per (group, member). No operator gathers the
members of a group into an array, so a group may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.coding import target_coding_keys
from ..functions.ranking import extreme_row, top_k
from ..functions.text import (
    blank_to_null,
    first_text,
    named_id,
    norm_text,
    sorted_distinct,
    title_case_parts,
)
from . import classify
from .records import known_category_bucket, record_bucket, status_kind, status_rank, visible

STRINGS = "array<string>"

# Names a group of observations must not get unless a member is called so.
UNSAFE_NAMES = (
    "blood counts", "blood count", "blood sugar", "blood pressure", "cardiovascular", "cholesterol", "diabetes",
    "diabetes monitoring", "high blood pressure", "hypertension", "kidney disease", "kidney function", "lab",
    "lab result", "lab results", "laboratory", "liver disease", "liver function", "metabolic health",
    "type 2 diabetes", "vital sign", "vital signs",
)
UNSAFE_PHRASES = ("care program", "diabetes", "disease", "monitoring", "screening")


def _strings(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(STRINGS))


def label_name() -> Column:
    return F.coalesce(blank_to_null(F.trim("source_label")), F.col("resource_type"))


def normal_label() -> Column:
    return F.trim(F.regexp_replace(F.lower(label_name()), r"\s+", " "))


def _normal_parts(values: Column) -> Column:
    return F.filter(F.transform(sorted_distinct(values), norm_text), lambda v: v != "")


def source_concept_key() -> Column:
    codings = F.flatten(F.transform(F.coalesce(F.col("code_codings"), F.array().cast("array<struct<code:string,display:string>>")), lambda c: F.array(c["code"], c["display"])))
    everything = F.concat(_strings("coding_keys"), F.array("source_label"), _strings("code_texts"), codings)
    return F.array_join(_normal_parts(everything), "|")


def with_key_parts(records: DataFrame) -> DataFrame:
    """Add the parts that group and concept keys are made of, each computed once per record."""
    first = records.withColumns(
        {
            "_own_keys": sorted_distinct(_strings("coding_keys")),
            "_ingredient_names": sorted_distinct(_strings("ingredients")),
            "_route": blank_to_null(norm_text(F.col("route"))),
            "_category": norm_text(first_text(F.col("category_code"), F.col("category"))),
            "_label": normal_label(),
        }
    )
    is_med = F.col("resource_type") == "MedicationRequest"
    return first.withColumns(
        {
            "_keys": target_coding_keys(F.col("resource_type"), F.col("_own_keys")),
            "_ingredients": F.when(is_med, F.filter(F.transform("_ingredient_names", norm_text), lambda v: v != "")),
            "_concept": F.when(F.size("_own_keys") > 0, source_concept_key()),
        }
    )


KEY_PARTS = ("_own_keys", "_ingredient_names", "_route", "_category", "_label", "_keys", "_ingredients", "_concept")


def grouping_basis() -> Column:
    """STRUCT<group_id, name, confidence, reason, fallback> over ``with_key_parts``: ingredients and route, then code, concept, label."""
    kind = F.lower("resource_type")
    ingredients, route, keys = F.col("_ingredients"), F.col("_route"), F.col("_keys")
    shown = title_case_parts(F.concat(F.col("_ingredient_names"), F.array(F.coalesce("route", F.lit("")))))
    code_key, concept_key = F.array_join(keys, "|"), F.col("_concept")

    def basis(gid: Column, name: Column, confidence, reason, fallback: bool = False) -> Column:
        conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
        why = reason if isinstance(reason, Column) else F.lit(reason)
        return F.struct(gid.alias("group_id"), name.alias("name"), conf.alias("confidence"), why.alias("reason"), F.lit(fallback).alias("fallback"))

    routed = route.isNotNull()
    by_ingredient = basis(
        F.when(routed, F.concat(F.lit("medicationrequest-ingredient-route-"), named_id(F.array_join(F.concat(ingredients, F.array(route)), "-")))).otherwise(
            F.concat(F.lit("medicationrequest-ingredient-"), named_id(F.array_join(ingredients, "-")))
        ),
        F.coalesce(blank_to_null(shown), label_name()),
        F.when(routed, 0.8).otherwise(0.7),
        F.when(routed, "Grouped by source medication ingredient and route.").otherwise("Grouped by source medication ingredient."),
    )
    return (
        F.when(F.size(ingredients) > 0, by_ingredient)
        .when(F.size(keys) > 0, basis(F.concat(kind, F.lit("-target-code-"), named_id(code_key)), label_name(), 0.8, "Grouped by preferred source standard code."))
        .when(F.size("_own_keys") > 0, basis(F.concat(kind, F.lit("-concept-"), named_id(concept_key)), label_name(), 0.75, "Grouped by identical source code/display/text."))
        .otherwise(basis(F.concat(kind, F.lit("-label-"), named_id(F.coalesce(blank_to_null(F.col("_label")), F.col("id")))), label_name(), 0.55, "Grouped by exact source label.", True))
    )


def compact_key() -> Column:
    """Records with equal keys are one concept to be named; over ``with_key_parts``."""
    rtype, keys, own, ingredients, route = F.col("resource_type"), F.col("_keys"), F.col("_own_keys"), F.col("_ingredients"), F.col("_route")
    join = lambda *parts: F.concat_ws("|", *parts)
    is_med, is_obs = rtype == "MedicationRequest", rtype == "Observation"
    head = F.when(is_obs, join(rtype, F.col("_category"))).otherwise(rtype)
    return (
        F.when((F.size(ingredients) > 0) & route.isNotNull(), join(rtype, F.lit("ingredient-route"), F.array_join(ingredients, "+"), route))
        .when(F.size(ingredients) > 0, join(rtype, F.lit("ingredient"), F.array_join(ingredients, "+")))
        .when(F.size(keys) > 0, join(head, F.lit("target-code"), F.array_join(keys, "|")))
        .when(is_med & (F.size(own) > 0), join(rtype, F.lit("code"), F.array_join(own, "|")))
        .when(F.size(own) > 0, join(head, F.lit("concept"), F.col("_concept")))
        .otherwise(join(head, F.lit("label"), F.col("_label")))
    )


def with_compact_id(records: DataFrame) -> DataFrame:
    keyed = with_key_parts(visible(records)).withColumn("_key", compact_key())
    return keyed.withColumn("compact_id", F.concat(F.lit("cluster:"), F.col("resource_type"), F.lit(":"), F.md5(F.col("_key")))).drop(*KEY_PARTS, "_key")


def most_common_label(labelled: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The most frequent label per key, ties in binary order."""
    counts = labelled.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("label")))["label"].alias(label))


def compact_records(records: DataFrame) -> dict[str, DataFrame]:
    """``concepts`` (one row per key), ``members`` (concept, record) and distinct ``values`` (concept, field, value).

    Scalars are algebraic aggregates; value lists stay rows, deduplicated by a partial aggregation.
    """
    keyed = with_compact_id(records)
    k = ["patient_id", "compact_id"]
    first = F.min_by(F.struct("resource_type", "category", "category_code", "unit", "value_kind", "dosage_form", "route", "canonical_unit", "status", "display_value", "canonical_value"), F.struct("input_pos", "id"))
    date = F.max(F.greatest(F.trim("latest_date"), F.trim("date")))
    scalars = keyed.groupBy(*k).agg(
        first.alias("_f"),
        F.count(F.lit(1)).alias("_n"),
        F.min("input_pos").alias("first_pos"),
        blank_to_null(date).alias("date"),
        F.bool_or(F.col("source") == "patient").alias("_patient"),
        F.bool_or(F.coalesce("inactive_overlay", F.lit(False))).alias("inactive_overlay"),
    )
    labels = most_common_label(keyed.withColumn("source_label", label_name()).select(*k, "source_label"), k, "source_label")
    single = lambda name: F.when(F.col("_n") == 1, F.col(f"_f.{name}")).alias(name)
    concepts = scalars.join(labels, k).select(
        *k,
        *[F.col(f"_f.{c}").alias(c) for c in ("resource_type", "category", "category_code", "unit", "value_kind", "dosage_form", "route", "canonical_unit")],
        single("status"),
        single("display_value"),
        single("canonical_value"),
        "source_label",
        "first_pos",
        "date",
        F.when(F.col("_patient"), "patient").otherwise("provider").alias("source"),
        "inactive_overlay",
        F.col("_n").alias("resource_count"),
    )
    members = keyed.select(*k, "resource_type", F.col("id").alias("record_id"))
    coded = F.transform(
        F.coalesce(F.col("code_codings"), F.array().cast("array<struct<code:string,display:string>>")),
        lambda c: F.concat_ws("|", F.coalesce(c["code"], F.lit("")), F.coalesce(c["display"], F.lit(""))),
    )
    texts = F.concat(F.array("grouping_text", "source_label", "category", "category_code", "unit", "value_kind", "dosage_form", "route"), _strings("coding_keys"), _strings("ingredients"))
    tag = lambda name, arr: F.transform(arr, lambda v: F.struct(F.lit(name).alias("field"), F.trim(v).alias("value")))
    tagged = F.concat(
        tag("coding_keys", _strings("coding_keys")),
        tag("code_texts", F.coalesce(F.col("code_texts"), F.array("source_label"))),
        tag("code_codings", coded),
        tag("ingredients", _strings("ingredients")),
        tag("source_labels", F.array("source_label")),
        tag("grouping_text", texts),
    )
    values = keyed.select(*k, F.explode(tagged).alias("_v")).select(*k, "_v.*").filter("value is not null and value <> ''").distinct()
    return {"concepts": concepts, "members": members, "values": values}


def grouping_texts(values: DataFrame, limit: int) -> DataFrame:
    """For display: sorted distinct text parts joined by ' | ', cut at ``limit`` characters. The parts themselves stay rows.

    A part takes at least four characters, so the first ``limit / 4`` parts decide the result: the list
    that is gathered has a fixed upper size.
    """
    parts = top_k(values.filter("field = 'grouping_text'"), ["patient_id", "compact_id"], [F.col("value")], limit // 4 + 1, "_r")
    joined = F.array_join(F.array_sort(F.collect_list("value")), " | ")
    return parts.groupBy("patient_id", "compact_id").agg(F.substring(joined, 1, limit).alias("grouping_text"))


def bucket_agreement(bucket: str = "bucket") -> Column:
    """The one distinct non-null bucket of a group, or null (does not depend on record order)."""
    return F.when(F.min(bucket) == F.max(bucket), F.max(bucket))


def deterministic_grouping(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups by source facts only, with their members."""
    rows = with_key_parts(visible(records)).withColumn("_b", grouping_basis())
    rows = rows.select("patient_id", "input_pos", "id", "resource_type", "_b.*", record_bucket(F.col("resource_type"), F.col("category"), F.col("category_code")).alias("bucket"))
    groups = rows.groupBy("patient_id", "group_id").agg(
        F.min_by("name", F.struct("input_pos", "id")).alias("name"),
        F.array_sort(F.collect_set("resource_type")).alias("resource_types"),
        F.min("confidence").alias("confidence"),
        F.bool_or("fallback").alias("fallback"),
        F.min_by("reason", F.struct("input_pos", "id")).alias("reason"),
        bucket_agreement().alias("bucket"),
        F.count(F.lit(1)).alias("n_records"),
    )
    members = rows.select("patient_id", "group_id", F.col("id").alias("record_id"), "resource_type", "input_pos")
    return groups, members


def source_groups(records: DataFrame) -> DataFrame:
    """One group per visible record; members and groups coincide."""
    gid = F.concat(F.lower("resource_type"), F.lit("-source-"), named_id(F.col("id")))
    return visible(records).select(
        "patient_id",
        gid.alias("group_id"),
        label_name().alias("name"),
        F.col("id").alias("record_id"),
        "resource_type",
        record_bucket(F.col("resource_type"), F.col("category"), F.col("category_code")).alias("bucket"),
        F.lit(0.5).alias("confidence"),
        F.lit("Source record displayed without model grouping.").alias("reason"),
        F.lit(True).alias("fallback"),
    )


def combine_groupings(groups: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge groups of several results that agree on types, bucket and normalised name.

    ``groups(patient_id, result_pos, group_pos, group_id, name, resource_types, bucket, confidence, reason, fallback, source)``,
    ``members(patient_id, result_pos, group_id, record_id)``. The first group of a key gives its id and name.
    """
    key = F.concat_ws(":", F.array_join(F.array_sort("resource_types"), "|"), F.coalesce("bucket", F.lit("")), named_id(F.col("name")))
    keyed = groups.withColumn("_key", key)
    first = F.min_by(F.struct("group_id", "name", "reason"), F.struct("result_pos", "group_pos", "group_id"))
    combined = keyed.groupBy("patient_id", "_key").agg(
        first.alias("_f"),
        F.min("resource_types").alias("resource_types"),
        F.min("bucket").alias("bucket"),
        F.min("confidence").alias("confidence"),
        F.bool_or("fallback").alias("fallback"),
        F.when(F.min("source") == F.max("source"), F.min("source")).otherwise("mixed").alias("_source"),
    )
    out = combined.select("patient_id", "_key", "_f.*", "resource_types", "bucket", "confidence", "fallback")
    link = keyed.select("patient_id", "result_pos", "group_id", "_key").join(out.select("patient_id", "_key", F.col("group_id").alias("new_group_id")), ["patient_id", "_key"])
    moved = members.join(link, ["patient_id", "result_pos", "group_id"]).select("patient_id", F.col("new_group_id").alias("group_id"), "record_id").distinct()
    return out.drop("_key"), moved


def result_source(groups: DataFrame) -> DataFrame:
    """Tag of a combined result: the single source tag, else ``mixed``."""
    return groups.groupBy("patient_id").agg(F.when(F.min("source") == F.max("source"), F.min("source")).otherwise("mixed").alias("source"))


def cached_groups(concepts: DataFrame, cache: DataFrame, lookup_model: str, complete: Column) -> tuple[DataFrame, DataFrame]:
    """Groups of concepts that have a complete cache entry, by (type, normalised name).

    ``concepts(patient_id, compact_id, concept_pos, resource_type, category, category_code)`` joined to
    ``cache(compact_id, name, bucket, confidence, fallback, model, lookup_*, canonical_*)``.
    """
    c = cache.select("compact_id", F.col("resource_type").alias("entry_type"), "name", "bucket", "confidence", "fallback", "model", "lookup_system", "lookup_code", "canonical_system", "canonical_code")
    rows = concepts.join(c, "compact_id").filter(complete)
    rows = rows.withColumn("_key", F.concat_ws(":", "resource_type", named_id(F.col("name")))).withColumn(
        "_bucket", F.coalesce("bucket", known_category_bucket(F.col("resource_type"), F.col("category"), F.col("category_code")))
    )
    own = F.nullif(F.col("canonical_system"), F.lit("")).isNotNull() & F.nullif(F.col("canonical_code"), F.lit("")).isNotNull()
    looked = F.nullif(F.col("lookup_system"), F.lit("")).isNotNull() & F.nullif(F.col("lookup_code"), F.lit("")).isNotNull()
    code = F.when(own, F.struct(F.col("canonical_system").alias("system"), F.col("canonical_code").alias("code"))).when(looked, F.struct(F.col("lookup_system").alias("system"), F.col("lookup_code").alias("code")))
    first = F.min_by(F.struct("resource_type", "name", code.alias("code")), F.struct("concept_pos", "compact_id"))
    groups = rows.groupBy("patient_id", "_key").agg(
        first.alias("_f"),
        F.min("confidence").alias("confidence"),
        F.bool_or("fallback").alias("fallback"),
        bucket_agreement("_bucket").alias("bucket"),
        F.count(F.lit(1)).alias("n_concepts"),
    )
    gid = F.concat(F.lower("_f.resource_type"), F.lit("-"), named_id(F.col("_f.name")))
    out = groups.select(
        "patient_id", gid.alias("group_id"), F.col("_f.name").alias("name"), F.col("_f.resource_type").alias("resource_type"),
        "bucket", "confidence", "fallback", F.col("_f.code.system").alias("canonical_system"), F.col("_f.code.code").alias("canonical_code"), "n_concepts",
    )
    members = rows.select("patient_id", F.concat(F.lower("resource_type"), F.lit("-"), named_id(F.col("name"))).alias("group_id"), "compact_id")
    return out, members


def expand_members(group_concepts: DataFrame, concept_members: DataFrame) -> DataFrame:
    """Concept members become record members; ids that are no concepts stay as they are."""
    m = concept_members.select("patient_id", "compact_id", "record_id")
    joined = group_concepts.join(m, ["patient_id", "compact_id"], "left")
    return joined.select("patient_id", "group_id", F.coalesce("record_id", "compact_id").alias("record_id")).distinct()


def split_fallback(groups: DataFrame, members: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fallback groups with several members fall apart into one group per record, confidence at most 0.5."""
    sizes = members.groupBy("patient_id", "group_id").agg(F.count(F.lit(1)).alias("_n"))
    sized = groups.join(sizes, ["patient_id", "group_id"])
    split = F.col("fallback") & (F.col("_n") > 1)
    kept = sized.filter(~split).drop("_n")
    apart = sized.filter(split).select("patient_id", "group_id", F.col("confidence").alias("_conf"), F.col("name").alias("_gname"), F.col("bucket").alias("_gbucket"), F.col("reason").alias("_greason"), F.col("resource_types").alias("_gtypes"))
    r = visible(records).select("patient_id", F.col("id").alias("record_id"), "resource_type", label_name().alias("_label"), record_bucket(F.col("resource_type"), F.col("category"), F.col("category_code")).alias("_rbucket"))
    rows = apart.join(members, ["patient_id", "group_id"]).join(r, ["patient_id", "record_id"], "left")
    known = F.col("resource_type").isNotNull()
    new_id = F.when(known, F.concat(F.lower("resource_type"), F.lit("-source-"), named_id(F.col("record_id")))).otherwise(
        F.concat("group_id", F.lit("-source-"), named_id(F.col("record_id")))
    )
    singles = rows.select(
        "patient_id",
        new_id.alias("group_id"),
        "record_id",
        F.when(known, F.col("_label")).otherwise(F.col("_gname")).alias("name"),
        F.when(known, F.array("resource_type")).otherwise(F.col("_gtypes")).alias("resource_types"),
        F.when(known, F.col("_rbucket")).otherwise(F.col("_gbucket")).alias("bucket"),
        F.least("_conf", F.lit(0.5)).alias("confidence"),
        F.when(known, F.lit("Source record fallback for ungrouped local model output.")).otherwise(F.col("_greason")).alias("reason"),
        F.lit(True).alias("fallback"),
    )
    out = kept.select("patient_id", "group_id", "name", "resource_types", "bucket", "confidence", "reason", "fallback").unionByName(singles.drop("record_id"))
    kept_members = members.join(kept.select("patient_id", "group_id"), ["patient_id", "group_id"], "left_semi")
    return out, kept_members.select("patient_id", "group_id", "record_id").unionByName(singles.select("patient_id", "group_id", "record_id"))


def unassigned_records(records: DataFrame, members: DataFrame) -> DataFrame:
    """Visible records that no group holds."""
    ids = members.select("patient_id", F.col("record_id").alias("id"))
    return visible(records).join(ids, ["patient_id", "id"], "left_anti")


def free_ids(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """``(patient_id, group_id, _new)``: each wanted id, or with the first ``-fallback-n`` behind it that no taken id has.

    A taken id holds number 0 of itself and, if it ends in ``-fallback-n``, number n of what stands before. In the order of
    the numbers held, the first one above its own place leaves its place free.
    """
    tail = F.regexp_extract("group_id", r"^(?s:(.*))-fallback-([1-9]\d{0,17})$", 2)
    head = F.regexp_extract("group_id", r"^(?s:(.*))-fallback-([1-9]\d{0,17})$", 1)
    own = F.struct(F.col("group_id"), F.lit(0).cast("bigint").alias("n"))
    held = F.when(tail == "", F.array(own)).otherwise(F.array(own, F.struct(head.alias("group_id"), tail.cast("bigint").alias("n"))))
    numbers = taken.select("patient_id", F.explode(held).alias("_h")).select("patient_id", "_h.*").distinct().join(wanted, ["patient_id", "group_id"], "left_semi")
    placed = numbers.withColumn("_place", F.row_number().over(Window.partitionBy("patient_id", "group_id").orderBy("n")).cast("bigint") - 1)
    first = placed.groupBy("patient_id", "group_id").agg(F.coalesce(F.min(F.when(F.col("n") > F.col("_place"), F.col("_place"))), F.count(F.lit(1))).alias("_free"))
    free = wanted.join(first, ["patient_id", "group_id"], "left")
    return free.select("patient_id", "group_id", F.when(F.coalesce("_free", F.lit(0)) == 0, F.col("group_id")).otherwise(F.concat("group_id", F.lit("-fallback-"), F.col("_free").cast("string"))).alias("_new"))


def leftover_groups(records: DataFrame, fallback: DataFrame, fallback_members: DataFrame, assigned: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fallback groups cut to the records nobody took, with ids that are not in use.

    A clash gets the first free ``-fallback-n``; see ``free_ids``.
    """
    free = unassigned_records(records, assigned).select("patient_id", F.col("id").alias("record_id"), "resource_type", "category", "category_code")
    first_group = extreme_row(
        fallback_members.join(fallback.select("patient_id", "group_id", "group_pos"), ["patient_id", "group_id"]).select("patient_id", "record_id", "group_pos", "group_id"),
        ["patient_id", "record_id"], ["group_pos", "group_id"], "min",
    )
    rows = first_group.join(free, ["patient_id", "record_id"]).withColumn("_b", record_bucket(F.col("resource_type"), F.col("category"), F.col("category_code")))
    regrouped = rows.groupBy("patient_id", "group_id").agg(F.array_sort(F.collect_set("resource_type")).alias("resource_types"), bucket_agreement("_b").alias("bucket"))
    info = fallback.select("patient_id", "group_id", "name", "confidence", "reason")
    groups = regrouped.join(info, ["patient_id", "group_id"])
    chosen = free_ids(groups.select("patient_id", "group_id"), taken)
    out = groups.join(chosen, ["patient_id", "group_id"]).select(
        "patient_id", F.col("_new").alias("group_id"), "name", "resource_types", "bucket",
        F.least("confidence", F.lit(0.55)).alias("confidence"),
        F.coalesce(blank_to_null(F.col("reason")), F.lit("Fallback grouping for records left unassigned by the local model.")).alias("reason"),
        F.lit(True).alias("fallback"),
    )
    members = rows.select("patient_id", "group_id", "record_id").join(chosen, ["patient_id", "group_id"]).select("patient_id", F.col("_new").alias("group_id"), "record_id")
    return out, members


def unsafe_observation_name(name: Column) -> Column:
    """True for names too broad or too clinical for a group of observations."""
    text = norm_text(name)
    phrase = F.lit(False)
    for p in UNSAFE_PHRASES:
        phrase = phrase | F.contains(text, F.lit(p))
    return (
        F.when(text == "", True)
        .when(text.isin(*UNSAFE_NAMES), True)
        .when(F.contains(text, F.lit("blood pressure")), ~text.rlike(r"\b(systolic|diastolic|mean arterial|orthostatic)\b"))
        .when(F.contains(text, F.lit("cholesterol")), ~text.rlike(r"\b(ldl|hdl|total|non hdl|triglycerides?)\b"))
        .otherwise(phrase)
    )


def rejected_groups(groups: DataFrame, members: DataFrame, records: DataFrame) -> DataFrame:
    """Groups of observations only, with an unsafe name that no member carries in the source."""
    concepts = F.concat(
        F.array("source_label"), _strings("code_texts"),
        F.transform(F.coalesce(F.col("code_codings"), F.array().cast("array<struct<code:string,display:string>>")), lambda c: c["display"]),
    )
    r = records.select("patient_id", F.col("id").alias("record_id"), "resource_type", concepts.alias("_concepts"))
    named = groups.select("patient_id", "group_id", "name").filter(unsafe_observation_name(F.col("name")))
    rows = members.select("patient_id", "group_id", "record_id").join(named, ["patient_id", "group_id"]).join(r, ["patient_id", "record_id"])
    own = F.exists("_concepts", lambda c: (norm_text(c) == norm_text(F.col("name"))) & (norm_text(c) != ""))
    judged = rows.groupBy("patient_id", "group_id").agg(F.bool_and(F.col("resource_type") == "Observation").alias("_only"), F.bool_or(F.coalesce(own, F.lit(False))).alias("_own"))
    return judged.filter("_only and not _own").select("patient_id", "group_id")


def group_status(member_records: DataFrame, keys: list[str]) -> DataFrame:
    """Status of a group by precedence active > on-hold > remission > ... > unknown."""
    kind = status_kind(F.col("resource_type"), F.col("status"))
    rows = member_records.withColumn("_kind", kind)
    return rows.groupBy(*keys).agg(F.min_by("_kind", status_rank(F.col("_kind"))).alias("status_kind"))


def group_order(mode: str = "count") -> list[Column]:
    """Sort order of a group list by ``n_records``, ``name`` or ``latest`` date; undated groups come last."""
    first = {
        "count": [F.col("n_records").desc()],
        "name": [],
        "newest": [F.coalesce("latest", F.lit("")).desc()],
        "oldest": [F.col("latest").asc_nulls_last()],
    }[mode]
    return [*first, F.col("name")]


def visit_class_counts(visits: DataFrame, keys: list[str]) -> DataFrame:
    """Number of visits per class; ``chosen_class`` of a person goes before the one that the words give."""
    label = F.coalesce("chosen_class", classify.classify_visit(F.col("words"))["label"])
    return visits.groupBy(*keys, label.alias("visit_class")).agg(F.count(F.lit(1)).alias("n"))


def category_counts(df: DataFrame, column: str, categories: list[str], keys: list[str] | None = None) -> DataFrame:
    """Count per category as columns, zero where a category does not occur."""
    return df.groupBy(*(keys or [])).agg(*[F.count_if(F.col(column) == c).alias(c) for c in categories])


def group_cards(clusters: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Figures of a group card from ``clusters(keys, duplicate_count, canonical_date)`` and its records."""
    a = clusters.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("duplicate_count").cast("bigint").alias("n_duplicates"), F.max("canonical_date").alias("latest_date")
    )
    portals = records.select(*keys, "portal_source_id").filter("portal_source_id is not null").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_portals"))
    return a.join(portals, keys, "left").withColumn("n_portals", F.coalesce("n_portals", F.lit(0)))


def other_portals(cluster_members: DataFrame) -> DataFrame:
    """Portals, other than the canonical record's, that hold a copy of it (``is_canonical`` marks that record)."""
    rows = cluster_members.withColumn("_p", F.coalesce(blank_to_null(F.col("portal_source_name")), F.col("portal_source_id")))
    home = rows.filter("is_canonical").select("patient_id", "cluster_id", F.col("_p").alias("_home"))
    others = rows.filter("not is_canonical and _p is not null").select("patient_id", "cluster_id", "_p").distinct()
    return others.join(home, ["patient_id", "cluster_id"], "left").filter(~F.col("_p").eqNullSafe(F.col("_home"))).select("patient_id", "cluster_id", F.col("_p").alias("portal"))


def duplicate_chip(cluster_members: DataFrame) -> DataFrame:
    """'Also in X' where one other portal has a copy, else the number of matching records."""
    sizes = cluster_members.groupBy("patient_id", "cluster_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    others = other_portals(cluster_members).groupBy("patient_id", "cluster_id").agg(F.count(F.lit(1)).alias("_p"), F.min("portal").alias("_one"))
    chip = F.when(F.col("_p") == 1, F.concat(F.lit("Also in "), "_one")).otherwise(F.concat(F.col("_n").cast("string"), F.lit(" matching records")))
    return sizes.join(others, ["patient_id", "cluster_id"], "left").select("patient_id", "cluster_id", chip.alias("chip"))
