"""The main pipeline: open resources of many patients to a ranked summary per patient.

Tables that several later stages read (records, groups, members, group edges, clusters of copies) are saved once, which runs
jobs while the plan is built; everything else stays lazy.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.text import relationship_group_key
from ..operators import bm25, classify, dedupe, evidence, grouping, normalize, priority, ranges, records, relationships, terminology, trends
from ..operators.state import ASSOCIATION_VERSION
from ..session import saved


#: The code system in which the association tables name the records of each type.
LINKED_SYSTEMS = {"Condition": "icd10cm", "Observation": "loinc", "MedicationRequest": "rxnorm"}


@dataclass
class Terminology:
    """Tables the pipeline joins against, each a DataFrame (see the README for their columns)."""

    terms: DataFrame
    corpus: DataFrame
    weights: DataFrame
    ranges: DataFrame
    assoc_labs: DataFrame
    assoc_meds: DataFrame
    ingredients: DataFrame


@dataclass
class Summary:
    records: DataFrame
    groups: DataFrame
    members: DataFrame
    edges: DataFrame
    group_edges: DataFrame
    trends: DataFrame
    flags: DataFrame
    ranked: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)


def named_concepts(concepts: DataFrame, values: DataFrame, t: Terminology) -> DataFrame:
    """Name of every concept: terminology by code, then text search for the rest, then its own label."""
    k = ["patient_id", "compact_id"]
    keys = values.filter("field = 'coding_keys'").groupBy(*k).agg(F.array_sort(F.collect_set("value")).alias("coding_keys"))
    parts = values.filter("field = 'ingredients'").groupBy(*k).agg(F.array_sort(F.collect_set("value")).alias("ingredients"))
    none = F.array().cast("array<string>")
    rich = concepts.join(keys, k, "left").join(parts, k, "left").withColumns(
        {"coding_keys": F.coalesce("coding_keys", none), "ingredients": F.coalesce("ingredients", none), "code_texts": none, "code_codings": F.array().cast("array<struct<code:string,display:string>>")}
    )
    by_code = terminology.friendly_names(rich, t.terms, k).select(
        *k, "name", "confidence", "fallback", F.coalesce("canonical_system", "system").alias("canonical_system"), F.coalesce("canonical_code", "code").alias("canonical_code")
    )
    open_concepts = rich.join(by_code.select(*k), k, "left_anti")
    index = bm25.build_index(t.corpus.select("category", "rid", "text"))
    by_text = bm25.name_records(open_concepts, index, t.corpus, k).select(
        *k, F.col("friendly").alias("name"), "confidence", F.lit(False).alias("fallback"), F.col("system").alias("canonical_system"), F.col("code").alias("canonical_code")
    )
    named = by_code.unionByName(by_text)
    joined = concepts.join(named, k, "left")
    return joined.withColumns({"name": F.coalesce("name", "source_label"), "confidence": F.coalesce("confidence", F.lit(0.5)), "fallback": F.coalesce("fallback", F.lit(True))})


def concept_groups(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts of one type and normalised name form a group."""
    from ..functions.text import named_id, norm_text

    gid = F.concat(F.lower("resource_type"), F.lit("-"), named_id(F.col("name")))
    rows = named.withColumns({"group_id": gid, "bucket": records.known_category_bucket(F.col("resource_type"), F.col("category"), F.col("category_code")), "_n": norm_text(F.col("name"))})
    groups = rows.groupBy("patient_id", "group_id").agg(
        F.min("resource_type").alias("resource_type"), F.min("name").alias("name"), F.min("first_pos").alias("group_pos"), grouping.bucket_agreement().alias("bucket"), F.min("confidence").alias("confidence"), F.bool_or("fallback").alias("fallback"),
        F.min_by(F.struct("canonical_system", "canonical_code"), F.when(F.col("canonical_code").isNotNull(), F.col("compact_id"))).alias("_c"),
    )
    keyed = groups.withColumn("group_key", relationship_group_key(F.array("resource_type"), F.col("group_id")))
    return keyed.select("patient_id", "group_id", "group_key", "group_pos", "resource_type", "name", "bucket", "confidence", "fallback", "_c.*"), rows.select("patient_id", "group_id", "compact_id")


def summarise(resources: DataFrame, patients: DataFrame, patches: DataFrame, t: Terminology, now_ms: int, size: int = priority.SECTION_SIZE) -> Summary:
    """``resources`` in the record model, ``patients(patient_id, sex, age)``, ``patches`` as for the overlay."""
    typed = normalize.typed_summary(resources)
    rows = saved(records.overlay_patches(records.unify(typed), patches))
    # From here on a record is named by source, type and id; members, measurements and names all use that.
    compact = grouping.compact_records(rows.withColumn("id", records.record_identity(F.col("resource_type"))))
    groups, group_concepts = concept_groups(named_concepts(compact["concepts"], compact["values"], t))
    groups = saved(groups)
    members = saved(grouping.expand_members(group_concepts, compact["members"]))

    # Links: references between records, then associations between groups.
    edges = relationships.explicit_edges(resources)
    g = ["patient_id", "group_id"]
    # A code counts only in the system that the associations of its type are written in.
    in_system = reduce(lambda acc, pair: acc.when((F.col("resource_type") == pair[0]) & (F.col("canonical_system") == pair[1]), F.col("canonical_code")), LINKED_SYSTEMS.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    keyed = groups.select(*g, "group_key", "group_pos", "resource_type", "name", in_system.alias("canonical_code"))
    conditions = keyed.filter("resource_type = 'Condition'").select("patient_id", "group_key", "group_pos", F.col("canonical_code").alias("code"), "name")
    # Members speak for their group: only groups with completed results are linked, and medications by their members' product codes.
    identified = rows.withColumns({"id": records.record_identity(F.col("resource_type")), "portal_source_id": F.coalesce("portal_source_id", "source_id")})
    member_records = saved(members.select(*g, F.col("record_id").alias("id")).join(identified, ["patient_id", "id"]))
    linked = groups.select(*g, "group_key", "resource_type", "bucket", in_system.alias("canonical_code"))
    lab_groups = evidence.observed_groups(linked, member_records, g).filter("canonical_code is not null").select("patient_id", F.col("group_key").alias("source_group"), F.col("canonical_code").alias("code"))
    codes = evidence.medication_codes(linked.filter("resource_type = 'MedicationRequest'"), member_records, g).join(linked.select(*g, "group_key"), g)
    med_groups = codes.select("patient_id", F.col("group_key").alias("source_group"), "code", F.array().cast("array<string>").alias("given"))
    subject = ["patient_id", "source_group"]
    lab_found = terminology.lab_conditions(lab_groups, t.assoc_labs, subject)
    med_found = terminology.medication_conditions(med_groups, t.ingredients, t.assoc_meds, subject)
    link = lambda found, kind, relation, model: relationships.group_condition_edges(found, conditions, kind, relation, model, ASSOCIATION_VERSION, now_ms)
    group_edges = saved(
        link(lab_found, "Observation", "monitoring_marker", "deterministic:condition-lab").unionByName(link(med_found, "MedicationRequest", "treatment", "deterministic:condition-med"))
    )

    # Copies that came through several portals count once in every group.
    clusters, copies = (saved(x) for x in dedupe.dedupe(member_records))
    cards = grouping.group_cards(clusters, member_records.filter(~F.coalesce("hidden", F.lit(False))), g)

    # Measurements of a group: trend, reference range, out-of-range flag, recency.
    obs = typed["Observation"].select("patient_id", records.record_identity(F.lit("Observation")).alias("record_id"), "input_pos", "value", F.col("effective_date").alias("date"), "reference_range", "coding_keys")
    measured = members.join(obs, ["patient_id", "record_id"])
    points = measured.select(*g, F.col("value.numeric_value").alias("value"), F.coalesce("value.ucum_code", "value.display_unit").alias("unit"), "date", "input_pos")
    with_ranges = measured.select(*g, "date", "input_pos", "reference_range.low", "reference_range.high", "reference_range.unit", "reference_range.ucum_code", "reference_range.text")
    codes = measured.select(*g, F.explode("coding_keys").alias("_k"), F.col("input_pos").alias("code_pos")).filter("_k like 'loinc:%'").select(*g, F.expr("substring(_k, 7)").alias("code"), "code_pos")
    bounds = ranges.group_ranges(groups.select(*g, "name", "canonical_system", "canonical_code"), with_ranges, codes, t.ranges, patients)
    tested = ranges.in_range(points.join(bounds.select(*g, "low", "high", F.col("unit").alias("range_unit"), "molecular_weight"), g), molecular_weight="molecular_weight")
    flags = ranges.out_of_range_groups(tested, g)
    recent = priority.has_recent_value(measured, g, now_ms)

    # Score and rank.
    weights = terminology.weights_by_code(keyed.filter("resource_type = 'Condition'"), t.weights, "canonical_code").select("patient_id", "group_key", "weight")
    inherited = priority.inherited_weights(group_edges, weights)
    section = F.when(F.col("resource_type") == "Condition", "condition").when(F.col("resource_type") == "Observation", "observation").otherwise("other")
    scored = priority.display_scores(
        groups.withColumn("section", section).join(weights, ["patient_id", "group_key"], "left").join(inherited, ["patient_id", "group_key"], "left").join(flags, g, "left").join(recent, g, "left")
    )
    ranked = priority.top_items(scored, ["patient_id", "resource_type"], "group_id", size=size)
    # Across all sections, what a condition already shows beside it is left out.
    latest = measured.join(groups.select(*g, "group_key"), g).groupBy("patient_id", "group_key").agg(F.max("date").alias("latest_date"))
    claims = relationships.claimed_labs(group_edges, latest, now_ms).select("patient_id", "group_key").unionByName(
        relationships.claim_medications(med_found, conditions.select("patient_id", "group_key", "group_pos", "code", "name")).select("patient_id", F.col("medication_group").alias("group_key"))
    )
    overview = priority.overview(scored, claims, "group_id")
    record_names = members.join(groups.select(*g, "resource_type", "name"), g).select("patient_id", "record_id", "group_id", "name")
    return Summary(rows, groups, members, edges, group_edges, trends.detect_trends(points, g), flags, ranked, {"ranges": bounds, "scored": scored, "record_names": record_names, "clusters": clusters, "copies": copies, "cards": cards, "overview": overview})


def classified_records(rows: DataFrame) -> DataFrame:
    """Pattern classes of allergies, observations and visits, one row per record that has one."""
    words = records.visible(rows).withColumn("_words", classify.concept_words())
    result = (
        F.when(F.col("resource_type") == "AllergyIntolerance", classify.classify_allergy(F.col("_words")))
        .when(F.col("resource_type") == "Observation", classify.classify_observation(F.col("category"), F.col("category_code"), F.col("_words")))
        .when(F.col("resource_type") == "Encounter", classify.classify_visit(F.col("_words")))
    )
    return words.select("patient_id", "id", "resource_type", result.alias("_r")).filter("_r is not null").select("patient_id", "id", "resource_type", "_r.*")
