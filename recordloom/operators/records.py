"""The unified record table, patient-authored records and the patch overlay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import json_fields as J
from ..functions.coding import authored_coding_key, coding_keys, concept_codings, concept_text, text_or_label
from ..functions.text import blank_to_null, first_text, norm_status, sorted_distinct

RECORD_SCHEMA = (
    "source_id string, patient_id string, input_pos bigint, id string, resource_type string, source_label string, status string, "
    "category string, category_code string, unit string, value_kind string, date string, latest_date string, display_value string, "
    "canonical_value double, canonical_unit string, code_texts array<string>, code_codings array<struct<code:string,display:string>>, "
    "coding_keys array<string>, grouping_text string, ingredients array<string>, dosage_form string, route string, resource_count int, "
    "portal_source_id string, portal_source_name string, source string, hidden boolean, inactive_overlay boolean"
)
RECORD_TYPES = dict(c.strip().split(" ", 1) for c in RECORD_SCHEMA.replace("code:string,display:string", "code:string;display:string").split(","))
RECORD_TYPES = {k: v.replace(";", ",") for k, v in RECORD_TYPES.items()}

# Status vocabulary -> kind, per record type; kinds that count as active.
STATUS_KINDS = {
    "MedicationRequest": {
        "active": ["active"],
        "on-hold": ["on-hold", "hold", "paused"],
        "stopped": ["stopped", "ended", "cancelled", "canceled", "entered-in-error"],
        "completed": ["completed"],
    },
    "Condition": {
        "active": ["active", "recurrence", "relapse"],
        "remission": ["remission"],
        "resolved": ["resolved"],
        "inactive": ["inactive", "entered-in-error"],
    },
    "AllergyIntolerance": {
        "active": ["", "low", "high", "unable-to-assess", "active"],
        "resolved": ["resolved"],
        "inactive": ["inactive", "entered-in-error"],
    },
}
STATUS_PRECEDENCE = ["active", "on-hold", "remission", "resolved", "inactive", "stopped", "completed", "unknown"]


def as_records(df: DataFrame, **cols: Column) -> DataFrame:
    """Project to the record schema; columns not given are taken by name or left null."""
    out = []
    for name, dtype in RECORD_TYPES.items():
        if name in cols:
            expr = cols[name]
        elif name in df.columns:
            expr = F.col(name)
        else:
            expr = F.lit(None)
        out.append(expr.cast(dtype).alias(name))
    return df.select(*out)


def _words(*parts: Column) -> Column:
    """Blank-joined non-empty parts; array parts are spread."""
    return F.array_join(F.filter(F.concat(*parts), lambda p: blank_to_null(p).isNotNull()), " ")


def _merged_codings(first: str, second: str) -> Column:
    kind = "array<struct<code:string,display:string>>"
    both = F.concat(F.coalesce(F.col(f"{first}.codings"), F.array().cast(kind)), F.coalesce(F.col(f"{second}.codings"), F.array().cast(kind)))
    ordered = F.array_sort(F.transform(F.array_distinct(both), lambda c: F.struct(F.concat_ws(" ", F.coalesce(c["code"], F.lit("")), F.coalesce(c["display"], F.lit(""))).alias("k"), c.alias("c"))))
    return F.transform(ordered, lambda x: x["c"])


def unify(summary: dict[str, DataFrame], authored: DataFrame | None = None) -> DataFrame:
    """Eight typed tables and authored records as one table of records."""
    kind = {k: F.lit(k) for k in summary}
    label = F.col("label")
    texts, codings = text_or_label(F.col("code_summary"), label), F.col("code_summary.codings")
    keys = F.col("coding_keys")
    parts: list[DataFrame] = []
    if "MedicationRequest" in summary:
        parts.append(as_records(summary["MedicationRequest"], resource_type=kind["MedicationRequest"], source_label=label, code_texts=texts, code_codings=codings, date=F.col("authored_at")))
    if "Condition" in summary:
        parts.append(as_records(summary["Condition"], resource_type=kind["Condition"], source_label=label, code_texts=texts, code_codings=codings, date=F.col("authored_at")))
    if "AllergyIntolerance" in summary:
        parts.append(
            as_records(
                summary["AllergyIntolerance"], resource_type=kind["AllergyIntolerance"], source_label=label, code_texts=texts, code_codings=codings,
                grouping_text=_words(F.array("label", "status", "criticality"), keys), date=F.col("authored_at"), display_value=F.col("criticality"),
            )
        )
    if "Observation" in summary:
        v = F.col("value")
        parts.append(
            as_records(
                summary["Observation"], resource_type=kind["Observation"], source_label=label, code_texts=texts, code_codings=codings,
                unit=v["display_unit"], value_kind=v["kind"], date=F.col("effective_date"), display_value=v["display"],
                canonical_value=v["canonical_value"], canonical_unit=v["canonical_unit"],
                grouping_text=_words(F.array(label, F.col("category"), F.col("category_code"), v["display_unit"], v["kind"]), keys),
            )
        )
    if "Immunization" in summary:
        cvx = F.transform("codes", lambda c: F.concat(F.lit("cvx:"), c))
        parts.append(
            as_records(
                summary["Immunization"], resource_type=kind["Immunization"], source_label=label, code_texts=texts, code_codings=codings,
                coding_keys=cvx, grouping_text=F.array_join(F.concat(F.array(label), cvx), " "), date=F.col("occurrence_date"),
            )
        )
    if "Encounter" in summary:
        main, reason = F.col("code_summary.text"), F.col("reason_summary.text")
        parts.append(
            as_records(
                summary["Encounter"], resource_type=kind["Encounter"], source_label=label, category=F.col("class_label"),
                code_texts=sorted_distinct(F.array(main, reason, label, F.col("class_label"), F.col("service_provider"))),
                code_codings=_merged_codings("code_summary", "reason_summary"),
                grouping_text=_words(F.array(label, F.col("class_label"), F.col("service_provider"), main, reason), keys),
                date=F.coalesce("period_start", "period_end"), display_value=F.col("service_provider"),
            )
        )
    if "Procedure" in summary:
        main, reason = F.col("code_summary.text"), F.col("reason_summary.text")
        parts.append(
            as_records(
                summary["Procedure"], resource_type=kind["Procedure"], source_label=label,
                code_texts=sorted_distinct(F.array(main, reason, label, F.col("category"))),
                code_codings=_merged_codings("code_summary", "reason_summary"),
                grouping_text=_words(F.array(label, F.col("category"), main, reason), keys), date=F.col("performed_date"),
            )
        )
    if "DiagnosticReport" in summary:
        main = F.col("code_summary.text")
        n = F.col("result_count")
        linked = F.when(n.isNotNull(), F.concat(n.cast("string"), F.lit(" linked "), F.when(n == 1, "result").otherwise("results")))
        parts.append(
            as_records(
                summary["DiagnosticReport"], resource_type=kind["DiagnosticReport"], source_label=label,
                code_texts=sorted_distinct(F.array(main, label, F.col("category"))), code_codings=codings,
                grouping_text=_words(F.array(label, F.col("category"), main), keys),
                date=F.coalesce("effective_date", "issued"), display_value=F.coalesce("conclusion", linked),
            )
        )
    if authored is not None:
        parts.append(authored_records(authored))
    return reduce(lambda a, b: a.unionByName(b), parts)


def authored_records(authored: DataFrame) -> DataFrame:
    """``authored(source_id, patient_id, input_pos, id, resource_type, label, status, authored_at, body)``; ``body`` may be null."""
    body = F.col("body")
    kind = J.text(body, "resourceType")
    is_med, is_imm, is_alg = kind == "MedicationRequest", kind == "Immunization", kind == "AllergyIntolerance"
    concept = F.when(is_med, J.concept(body, "medicationCodeableConcept")).when(is_imm, J.concept(body, "vaccineCode")).when(is_alg, J.concept(body, "code"))
    default = F.when(is_med, "Medication").when(is_imm, "Immunization").otherwise("Allergy")
    shaped = is_med | is_imm | is_alg
    label = F.when(shaped, F.coalesce(blank_to_null(concept_text(concept)), blank_to_null(F.col("label")), default)).otherwise(F.col("label"))

    def joined(path: str, name: str) -> Column:
        items = F.coalesce(J.field(body, path, f"array<struct<{name}:string>>"), F.array())
        return F.array_join(F.filter(F.transform(items, lambda i: i[name]), lambda t: blank_to_null(t).isNotNull()), "; ")

    dosage = blank_to_null(joined("dosageInstruction", "text"))
    reaction = blank_to_null(joined("reaction", "description"))
    criticality = J.text(body, "criticality")
    keys = coding_keys(concept, authored_coding_key)
    text = blank_to_null(concept["text"])
    date = (
        F.when(is_med, J.text(body, "authoredOn")).when(is_imm, J.text(body, "occurrenceDateTime")).when(is_alg, J.text(body, "recordedDate"))
    )
    status = (
        F.when(is_med | is_imm, J.text(body, "status"))
        .when(is_alg, F.coalesce(blank_to_null(concept_text(J.concept(body, "clinicalStatus"))), F.col("status")))
        .otherwise(F.col("status"))
    )
    none = F.lit(None).cast("string")
    return as_records(
        authored,
        resource_type=F.coalesce(kind, F.col("resource_type")),
        source_label=label,
        status=status,
        coding_keys=F.when(is_med | is_imm, keys),
        code_texts=F.when(shaped, F.array(F.coalesce(text, label))),
        code_codings=F.when(shaped, concept_codings(concept)),
        grouping_text=F.when(is_med, _words(F.array(label, text, dosage), keys)).when(is_imm, _words(F.array(label, text), keys)).when(is_alg, _words(F.array(label, reaction, criticality))),
        date=F.coalesce(date, F.col("authored_at")),
        display_value=F.when(is_med, dosage).when(is_alg, blank_to_null(F.concat_ws(" · ", criticality, reaction))).otherwise(none),
        source=F.lit("patient"),
    )


def overlay_patches(records: DataFrame, patches: DataFrame) -> DataFrame:
    """Set ``hidden`` and ``inactive_overlay`` from ``patches(target_type, target_id, field, value)``; source and patient narrow it where given."""
    keys = [c for c in ("source_id", "patient_id") if c in patches.columns]
    flags = patches.groupBy(*keys, F.col("target_type").alias("resource_type"), F.col("target_id").alias("id")).agg(
        F.bool_or((F.col("field") == "patientRecordVisibility") & (F.col("value") == "hidden")).alias("_hidden"),
        F.bool_or((F.col("field") == "patientRecordStatus") & (F.col("value") == "inactive")).alias("_inactive"),
    )
    joined = records.drop("hidden", "inactive_overlay").join(flags, [*keys, "resource_type", "id"], "left")
    return joined.withColumn("hidden", F.coalesce("_hidden", F.lit(False))).withColumn("inactive_overlay", F.coalesce("_inactive", F.lit(False))).drop("_hidden", "_inactive")


def record_identity(resource_type: Column, source_id: Column | None = None, record_id: Column | None = None) -> Column:
    """A record's name across sources and types: a bare id is unique within one type of one source only."""
    source = F.col("source_id") if source_id is None else source_id
    return F.concat_ws(":", F.coalesce(source, F.lit("")), resource_type, F.col("id") if record_id is None else record_id)


def visible(records: DataFrame) -> DataFrame:
    return records.filter(~F.coalesce("hidden", F.lit(False)))


def record_order(mode: str = "newest") -> list[Column]:
    """Sort order of a record list: by date, then label and id; undated records come last either way."""
    dated = F.coalesce("date", F.lit("")).desc() if mode == "newest" else blank_to_null(F.col("date")).asc_nulls_last()
    return [dated, F.col("source_label"), F.col("id")]


def status_kind(resource_type: Column, status: Column) -> Column:
    normal = norm_status(status)
    out = F.when(F.lit(False), F.lit("unknown"))
    for rtype, kinds in STATUS_KINDS.items():
        for kind, words in kinds.items():
            out = out.when((resource_type == rtype) & normal.isin(*words), kind)
    return out.otherwise("unknown")


def kind_is_active(kind: Column) -> Column:
    return kind.isin("active", "on-hold")


def status_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in STATUS_PRECEDENCE]), kind)


def relationship_eligible(records: DataFrame) -> DataFrame:
    """Completed, visible observations with a value."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    return records.filter(
        (F.col("resource_type") == "Observation")
        & ~flag("hidden")
        & ~flag("inactive_overlay")
        & norm_status(F.col("status")).isin("final", "amended", "corrected", "appended", "completed")
        & ~F.coalesce(F.col("value_kind"), F.lit("")).isin("absent", "unknown")
    )


def bucket_from_category(category: Column, category_code: Column) -> Column:
    """labs / vitals, null when the category says neither."""
    dashed = F.regexp_replace(F.lower(F.coalesce(first_text(category_code, category), F.lit(""))), "[^a-z0-9]+", "-")
    return F.when(dashed.isin("laboratory", "lab"), "labs").when(dashed.isin("vital-signs", "vital-sign"), "vitals")


def record_bucket(resource_type: Column, category: Column, category_code: Column) -> Column:
    return F.when(resource_type == "Observation", bucket_from_category(category, category_code))


def known_category_bucket(resource_type: Column, category: Column, category_code: Column) -> Column:
    """Like ``record_bucket``, but any other stated category is ``other``."""
    stated = first_text(category, category_code).isNotNull()
    return F.when((resource_type == "Observation") & stated, F.coalesce(bucket_from_category(category, category_code), F.lit("other")))


def newest_first(records: DataFrame, date: str = "date") -> DataFrame:
    return records.orderBy(F.coalesce(F.col(date), F.lit("")).desc())
