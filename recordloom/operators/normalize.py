"""Eight typed tables from open JSON resources.

Input: ``resources(source_id, patient_id, input_pos, resource_type, id, body VARIANT)``. A resource without
an id is named after its position, so a retried task gives the same id again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import json_fields as J
from ..functions.coding import (
    CONCEPT_TYPE,
    code_summary,
    coding_keys,
    coding_keys_of_all,
    concept_code,
    concept_codes,
    concept_text,
    first_concept_summary,
    first_concept_text,
)
from ..functions.text import blank_to_null, first_text, number_text, squash_spaces, trimmed_or_null
from .references import resource_index

KEYS = ["source_id", "patient_id", "input_pos"]
SUMMARY_TYPE = "struct<text:string,codings:array<struct<code:string,display:string>>>"

# Words that name a route of administration, first hit wins.
ROUTE_TERMS = [
    ("Sublingual", ["sublingual", "under the tongue"]),
    ("Buccal", ["buccal"]),
    ("Ophthalmic", ["ophthalmic", "eye drop", "eye drops", "in the eye", "to the eye"]),
    ("Otic", ["otic", "ear drop", "ear drops", "in the ear", "to the ear"]),
    ("Inhaled", ["inhalation", "inhaled", "inhaler", "nebulizer", "nebulised", "nebulized", "inhale"]),
    ("Nasal", ["intranasal", "nasal", "nostril"]),
    ("Transdermal", ["transdermal", "patch"]),
    ("Topical", ["topical", "cream", "ointment", "lotion", "gel", "shampoo", "foam"]),
    ("Rectal", ["rectal", "suppository"]),
    ("Vaginal", ["vaginal"]),
    ("Intravenous", ["intravenous", "iv"]),
    ("Intramuscular", ["intramuscular", "im"]),
    ("Subcutaneous", ["subcutaneous", "subcut", "sc"]),
    ("Injection", ["injection", "injectable", "inject", "syringe", "pen injector"]),
    ("Oral", ["by mouth", "mouth", "oral", "orally", "tablet", "capsule", "caplet", "chewable", "lozenge"]),
]
# Unit spellings -> canonical unit, factor, offset (canonical = (value + offset) * factor).
MASS_LENGTH_TEMPERATURE = [
    (["kg", "kilogram", "kilograms"], "kg", lambda v: v),
    (["g", "gram", "grams"], "kg", lambda v: v / 1000),
    (["[lb_av]", "lb", "lbs", "pound", "pounds"], "kg", lambda v: v * 0.45359237),
    (["cm", "centimeter", "centimeters"], "cm", lambda v: v),
    (["m", "meter", "meters"], "cm", lambda v: v * 100),
    (["[in_i]", "in", "inch", "inches"], "cm", lambda v: v * 2.54),
    (["cel", "c", "degc", "°c"], "Cel", lambda v: v),
    (["[degf]", "f", "degf", "°f"], "Cel", lambda v: (v - 32) / 1.8),
]
KEPT_UNITS = ["%", "mm[hg]", "/min", "{beats}/min"]


def route_words(*texts: Column) -> Column:
    joined = F.concat_ws(" ", *[F.when(F.trim(t) != "", t) for t in texts])
    return F.regexp_replace(F.lower(joined), "[^a-z0-9]+", " ")


def infer_route(words: Column) -> Column:
    """Route named by ``route_words``, projected first; null when none is. Those are whole words with one blank between, so terms are looked for with their blanks."""

    def named(spaced: Column) -> Column:
        out = F.when(F.trim(spaced) == "", F.lit(None).cast("string"))
        for route, terms in ROUTE_TERMS:
            out = out.when(reduce(Column.__or__, [F.contains(spaced, F.lit(f" {t} ")) for t in terms]), route)
        return out

    return F.get(F.transform(F.array(F.concat(F.lit(" "), words, F.lit(" "))), named), F.lit(0))


def canonical_quantity(value: Column, unit: Column, code: Column) -> Column:
    """STRUCT<value, unit> in the canonical unit; null when the unit is not one of the known ones."""
    chosen = first_text(code, unit)
    key = F.lower(F.trim(F.coalesce(chosen, F.lit(""))))
    result_value, result_unit = F.lit(None).cast("double"), F.lit(None).cast("string")
    for spellings, canonical, convert in MASS_LENGTH_TEMPERATURE:
        hit = key.isin(*spellings)
        result_value = F.when(hit, convert(value)).otherwise(result_value)
        result_unit = F.when(hit, canonical).otherwise(result_unit)
    kept = key.isin(*KEPT_UNITS)
    result_value = F.when(kept, value).otherwise(result_value)
    result_unit = F.when(kept, chosen).otherwise(result_unit)
    return F.when(result_unit.isNotNull(), F.struct(result_value.alias("value"), result_unit.alias("unit")))


OBSERVATION_VALUE = (
    "struct<kind:string,display:string,numeric_value:double,display_unit:string,ucum_code:string,"
    "canonical_value:double,canonical_unit:string,absent_reason:string>"
)


def value_fields(body: Column) -> Column:
    """The parts a value can come from, as one struct: project it first, so each field is read once."""
    concept_words = lambda path: blank_to_null(concept_text(J.concept(body, path)))
    return F.struct(
        J.number(body, "valueQuantity.value").alias("amount"),
        J.field(body, "valueQuantity", "struct<unit:string,code:string,comparator:string>").alias("quantity"),
        concept_words("valueCodeableConcept").alias("coded"),
        J.text(body, "valueString").alias("string"),
        J.boolean(body, "valueBoolean").alias("flag"),
        J.number(body, "valueInteger").alias("whole"),
        J.text(body, "valueDateTime").alias("moment"),
        J.field(body, "valuePeriod", "struct<start:string,end:string>").alias("period"),
        concept_words("dataAbsentReason").alias("reason"),
    )


def observation_value(parts: Column) -> Column:
    """One of nine value kinds out of ``value_fields``, first present wins."""

    def value(kind: str, display: Column, numeric=None, unit=None, ucum=None, canonical=None, reason=None) -> Column:
        missing = F.lit(None)
        return F.struct(
            F.lit(kind).alias("kind"),
            display.alias("display"),
            (numeric if numeric is not None else missing).cast("double").alias("numeric_value"),
            (unit if unit is not None else missing).cast("string").alias("display_unit"),
            (ucum if ucum is not None else missing).cast("string").alias("ucum_code"),
            (canonical["value"] if canonical is not None else missing).cast("double").alias("canonical_value"),
            (canonical["unit"] if canonical is not None else missing).cast("string").alias("canonical_unit"),
            (reason if reason is not None else missing).cast("string").alias("absent_reason"),
        )

    amount, quantity = parts["amount"], parts["quantity"]
    ucum = trimmed_or_null(quantity["code"])
    unit = F.coalesce(trimmed_or_null(quantity["unit"]), ucum)
    shown = F.concat_ws(" ", blank_to_null(quantity["comparator"]), number_text(amount), unit)
    start, end = blank_to_null(parts["period"]["start"]), blank_to_null(parts["period"]["end"])
    span = F.when(start.isNotNull() & end.isNotNull(), F.concat(start, F.lit(" to "), end)).otherwise(F.coalesce(start, end))
    return (
        F.when(amount.isNotNull(), value("quantity", shown, amount, unit, ucum, canonical_quantity(amount, quantity["unit"], quantity["code"])))
        .when(parts["coded"].isNotNull(), value("codeable-concept", parts["coded"]))
        .when(parts["string"].isNotNull(), value("string", parts["string"]))
        .when(parts["flag"].isNotNull(), value("boolean", parts["flag"].cast("string")))
        .when(parts["whole"].isNotNull(), value("integer", number_text(parts["whole"]), parts["whole"]))
        .when(parts["moment"].isNotNull(), value("datetime", parts["moment"]))
        .when(span.isNotNull(), value("period", span))
        .when(parts["reason"].isNotNull(), value("absent", parts["reason"], reason=parts["reason"]))
        .otherwise(value("unknown", F.lit("No value recorded")))
    )


def abnormal_flag(body: Column) -> Column:
    codings = F.flatten(F.transform(J.concepts(body, "interpretation"), lambda c: F.coalesce(c["coding"], F.array().cast("array<struct<system:string,code:string,display:string>>"))))
    codes = F.filter(F.transform(codings, lambda c: F.upper(c["code"])), lambda c: F.nullif(c, F.lit("")).isNotNull())
    return F.exists(codes, lambda c: ~c.isin("N", "NORMAL"))


RANGE_TYPE = (
    "struct<low:struct<value:variant,unit:string,code:string>,high:struct<value:variant,unit:string,code:string>,text:string>"
)


def resource_range(body: Column) -> Column:
    """First usable range of a resource: STRUCT<low, high, unit, ucum_code, text>, else null."""
    ranges = J.field(body, "referenceRange", f"array<{RANGE_TYPE}>")
    first = F.get(F.filter(ranges, lambda r: r["low"].isNotNull() | r["high"].isNotNull() | blank_to_null(r["text"]).isNotNull()), F.lit(0))

    def bound(side: str) -> Column:
        raw = first[side]["value"]
        return F.when(F.schema_of_variant(raw).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(raw, "$", "double"))

    low, high, words = bound("low"), bound("high"), trimmed_or_null(first["text"])
    return F.when(
        low.isNotNull() | high.isNotNull() | words.isNotNull(),
        F.struct(
            low.alias("low"),
            high.alias("high"),
            F.coalesce(first["low"]["unit"], first["high"]["unit"]).alias("unit"),
            F.coalesce(first["low"]["code"], first["high"]["code"]).alias("ucum_code"),
            words.alias("text"),
        ),
    )


def _of_type(resources: DataFrame, resource_type: str) -> DataFrame:
    name = F.coalesce(blank_to_null(F.col("id")), F.concat(F.lit("pos-"), F.col("input_pos").cast("string")))
    return resources.filter(F.col("resource_type") == resource_type).withColumn("_given_id", F.col("id")).withColumn("id", name)


def _body() -> Column:
    return F.col("body")


def _label(default: str, *texts: Column) -> Column:
    return F.coalesce(*[blank_to_null(t) for t in texts], blank_to_null(F.col("_given_id")), F.lit(default))


def _provider(df: DataFrame, *cols: Column) -> DataFrame:
    return df.select(*KEYS, "id", *cols, F.lit("provider").alias("source"))


MEDICATION_FIELDS = (
    f"struct<medicationReference:struct<reference:string,display:string>,medicationCodeableConcept:{CONCEPT_TYPE},code:{CONCEPT_TYPE},"
    f"dosageInstruction:array<struct<text:string,route:{CONCEPT_TYPE}>>,status:string,authoredOn:string>"
)


def medication_products(resources: DataFrame) -> DataFrame:
    """What requests take from the medication they refer to, worked out once per medication."""
    product = J.concept(_body(), "code")
    items = J.field(_body(), "ingredient", f"array<struct<itemCodeableConcept:{CONCEPT_TYPE},itemReference:struct<reference:string,display:string>>>")
    names = F.transform(
        F.coalesce(items, F.array()),
        lambda i: F.coalesce(blank_to_null(concept_text(i["itemCodeableConcept"])), blank_to_null(i["itemReference"]["display"]), blank_to_null(i["itemReference"]["reference"])),
    )
    fields = {
        "_product_label": blank_to_null(concept_text(product)),
        "_product_keys": coding_keys(product),
        "_product_summary": code_summary(product),
        "_ingredients": F.array_distinct(F.filter(names, lambda x: x.isNotNull())),
        "_form": concept_text(J.concept(_body(), "form")),
    }
    return resource_index(resources, ["Medication"], fields).select("source_id", F.col("key").alias("_ref"), *fields)


def medications(resources: DataFrame) -> DataFrame:
    """Medication requests, with the referenced medication of the same source looked up.

    The fields of both sides are read and worked out before the join, so no body is exchanged. ``_spread`` follows from the reference and
    deals the requests without one, which find nothing, to many tasks.
    """
    m = F.col("_m")
    own, ref_display, dosing = m["medicationCodeableConcept"], m["medicationReference"]["display"], F.coalesce(m["dosageInstruction"], F.array())
    routes = F.filter(F.transform(dosing, lambda d: blank_to_null(concept_text(d["route"]))), lambda r: r.isNotNull())
    words = F.filter(F.transform(dosing, lambda d: d["text"]), lambda t: F.trim(t) != "")
    requests = _of_type(resources, "MedicationRequest").withColumn("_m", F.try_variant_get(_body(), "$", MEDICATION_FIELDS)).select(
        *KEYS,
        "id",
        m["medicationReference"]["reference"].alias("_ref"),
        blank_to_null(concept_text(own)).alias("_own_label"),
        coding_keys(own).alias("_own_keys"),
        code_summary(own).alias("_own_summary"),
        ref_display.alias("_display"),
        F.coalesce(blank_to_null(concept_text(m["code"])), blank_to_null(F.col("_given_id")), F.lit("Medication")).alias("_name"),
        F.coalesce(m["status"], F.lit("unknown")).alias("status"),
        F.get(routes, F.lit(0)).alias("_route"),
        F.array_join(words, " ").alias("_words"),
        m["authoredOn"].alias("authored_at"),
    )
    spread = lambda df, other: df.withColumn("_spread", F.crc32(F.coalesce(F.col("_ref"), other).cast("binary")))
    # Sorted, never broadcast: a compressed file tells too little of how large its products are, and a broadcast passes through the driver.
    df = spread(requests, F.col("id")).join(spread(medication_products(resources), F.lit("")).hint("merge"), ["source_id", "_ref", "_spread"], "left")
    by_display = F.when(F.col("_display").isNotNull(), F.struct(F.col("_display").alias("text"), F.lit(None).cast("array<struct<code:string,display:string>>").alias("codings")))
    none = F.array().cast("array<string>")
    staged = df.select(
        *KEYS,
        "id",
        F.coalesce("_own_label", "_product_label", blank_to_null(F.col("_display")), blank_to_null(F.col("_ref")), "_name").alias("label"),
        "status",
        F.array_distinct(F.concat("_own_keys", F.coalesce("_product_keys", none))).alias("coding_keys"),
        F.coalesce("_own_summary", "_product_summary", by_display).alias("code_summary"),
        F.coalesce("_ingredients", none).alias("ingredients"),
        F.col("_form").alias("dosage_form"),
        "_route",
        "_words",
        "authored_at",
        F.lit("provider").alias("source"),
    )
    worded = staged.withColumn("_clean", F.when(F.col("_route").isNull(), route_words(F.col("label"), F.col("dosage_form"), F.col("_words"))))
    routed = worded.withColumn("route", F.coalesce("_route", infer_route(F.col("_clean"))))
    parts = F.concat(F.array("label"), F.col("ingredients"), F.array("dosage_form", "route"), F.col("coding_keys"))
    text = F.array_join(F.filter(parts, lambda p: blank_to_null(p).isNotNull()), " ")
    return routed.withColumn("grouping_text", text).drop("_route", "_words", "_clean")


def allergies(resources: DataFrame) -> DataFrame:
    code = F.col("_code")
    return _provider(
        _of_type(resources, "AllergyIntolerance").withColumn("_code", J.concept(_body(), "code")),
        _label("Allergy", concept_text(code)).alias("label"),
        concept_text(J.concept(_body(), "clinicalStatus")).alias("status"),
        J.text(_body(), "criticality").alias("criticality"),
        coding_keys(code).alias("coding_keys"),
        code_summary(code).alias("code_summary"),
        J.text(_body(), "recordedDate").alias("authored_at"),
    )


def conditions(resources: DataFrame) -> DataFrame:
    code = F.col("_code")
    return _provider(
        _of_type(resources, "Condition").withColumn("_code", J.concept(_body(), "code")),
        _label("Condition", concept_text(code)).alias("label"),
        concept_text(J.concept(_body(), "clinicalStatus")).alias("status"),
        coding_keys(code).alias("coding_keys"),
        code_summary(code).alias("code_summary"),
        F.coalesce(J.text(_body(), "recordedDate"), J.text(_body(), "onsetDateTime")).alias("authored_at"),
    )


def observations(resources: DataFrame) -> DataFrame:
    code = F.col("_code")
    category = F.get(F.col("_category"), F.lit(0))
    return _provider(
        _of_type(resources, "Observation").withColumns({"_parts": value_fields(_body()), "_code": J.concept(_body(), "code"), "_category": J.concepts(_body(), "category")}),
        _label("Observation", concept_text(code)).alias("label"),
        observation_value(F.col("_parts")).alias("value"),
        F.coalesce(J.text(_body(), "status"), F.lit("unknown")).alias("status"),
        concept_text(category).alias("category"),
        concept_code(category).alias("category_code"),
        coding_keys(code).alias("coding_keys"),
        code_summary(code).alias("code_summary"),
        F.coalesce(J.text(_body(), "effectiveDateTime"), J.text(_body(), "issued"), J.period_start(_body(), "effectivePeriod")).alias("effective_date"),
        concept_text(F.get(J.concepts(_body(), "interpretation"), F.lit(0))).alias("interpretation"),
        abnormal_flag(_body()).alias("abnormal"),
        resource_range(_body()).alias("reference_range"),
    )


def immunizations(resources: DataFrame) -> DataFrame:
    code = F.col("_code")
    return _provider(
        _of_type(resources, "Immunization").withColumn("_code", J.concept(_body(), "vaccineCode")),
        _label("Immunization", concept_text(code)).alias("label"),
        concept_codes(code).alias("codes"),
        code_summary(code).alias("code_summary"),
        J.text(_body(), "status").alias("status"),
        F.coalesce(J.text(_body(), "occurrenceDateTime"), J.text(_body(), "recorded")).alias("occurrence_date"),
    )


def practitioner_name(body: Column) -> Column:
    name = F.get(J.field(body, "name", "array<struct<text:string,given:array<string>,family:string>>"), F.lit(0))
    parts = F.concat(F.coalesce(name["given"], F.array().cast("array<string>")), F.array(name["family"]))
    joined = F.trim(F.array_join(F.filter(parts, lambda p: blank_to_null(p).isNotNull()), " "))
    return F.coalesce(trimmed_or_null(name["text"]), blank_to_null(joined))


def patient_name(body: Column) -> Column:
    """Official name first; its text, else given and family names."""
    names = J.field(body, "name", "array<struct<use:string,text:string,given:array<string>,family:string>>")
    official = F.get(F.filter(names, lambda n: n["use"] == "official"), F.lit(0))
    chosen = F.coalesce(official, F.get(names, F.lit(0)))
    parts = F.concat(F.coalesce(chosen["given"], F.array().cast("array<string>")), F.array(chosen["family"]))
    joined = squash_spaces(F.array_join(F.filter(parts, lambda p: blank_to_null(p).isNotNull()), " "))
    return F.coalesce(trimmed_or_null(chosen["text"]), blank_to_null(joined))


def encounters(resources: DataFrame) -> DataFrame:
    """Encounters with the name of the referenced provider of the same source."""
    visits = _of_type(resources, "Encounter").withColumn("_ref", J.field(_body(), "serviceProvider.reference", "string"))
    name = F.when(F.col("resource_type") == "Practitioner", practitioner_name(_body())).otherwise(J.text(_body(), "name"))
    named = resource_index(resources, ["Organization", "Practitioner", "Location"], {"_provider_name": name}).select("source_id", F.col("key").alias("_ref"), "_provider_name")
    class_label = F.coalesce(blank_to_null(J.field(_body(), "class.display", "string")), J.field(_body(), "class.code", "string"))
    df = visits.join(named, ["source_id", "_ref"], "left").withColumns({"_types": J.concepts(_body(), "type"), "_reasons": J.concepts(_body(), "reasonCode"), "_class": class_label})
    types, reasons, class_label = F.col("_types"), F.col("_reasons"), F.col("_class")
    provider = F.coalesce(blank_to_null(F.col("_provider_name")), blank_to_null(J.field(_body(), "serviceProvider.display", "string")), F.col("_ref"))
    return _provider(
        df,
        _label("Encounter", first_concept_text(types), first_concept_text(reasons), class_label, provider).alias("label"),
        J.text(_body(), "status").alias("status"),
        class_label.alias("class_label"),
        first_concept_summary(types).alias("code_summary"),
        first_concept_summary(reasons).alias("reason_summary"),
        F.array_distinct(F.concat(coding_keys_of_all(types), coding_keys_of_all(reasons))).alias("coding_keys"),
        J.field(_body(), "period.start", "string").alias("period_start"),
        J.field(_body(), "period.end", "string").alias("period_end"),
        provider.alias("service_provider"),
    )


def procedures(resources: DataFrame) -> DataFrame:
    code, reasons = F.col("_code"), F.col("_reasons")
    return _provider(
        _of_type(resources, "Procedure").withColumns({"_code": J.concept(_body(), "code"), "_reasons": J.concepts(_body(), "reasonCode")}),
        _label("Procedure", concept_text(code)).alias("label"),
        J.text(_body(), "status").alias("status"),
        concept_text(J.concept(_body(), "category")).alias("category"),
        code_summary(code).alias("code_summary"),
        first_concept_summary(reasons).alias("reason_summary"),
        F.array_distinct(F.concat(coding_keys(code), coding_keys_of_all(reasons))).alias("coding_keys"),
        F.coalesce(J.text(_body(), "performedDateTime"), J.text(_body(), "performedString"), J.period_start(_body(), "performedPeriod")).alias("performed_date"),
    )


def diagnostic_reports(resources: DataFrame) -> DataFrame:
    code = F.col("_code")
    results = F.size(F.coalesce(J.field(_body(), "result", "array<variant>"), F.array().cast("array<variant>")))
    return _provider(
        _of_type(resources, "DiagnosticReport").withColumn("_code", J.concept(_body(), "code")),
        _label("Diagnostic report", concept_text(code)).alias("label"),
        J.text(_body(), "status").alias("status"),
        first_concept_text(J.concepts(_body(), "category")).alias("category"),
        code_summary(code).alias("code_summary"),
        coding_keys(code).alias("coding_keys"),
        F.coalesce(J.text(_body(), "effectiveDateTime"), J.period_start(_body(), "effectivePeriod"), J.text(_body(), "issued")).alias("effective_date"),
        J.text(_body(), "issued").alias("issued"),
        F.nullif(results, F.lit(0)).alias("result_count"),
        trimmed_or_null(J.text(_body(), "conclusion")).alias("conclusion"),
    )


TYPED_TABLES = {
    "MedicationRequest": medications,
    "Condition": conditions,
    "AllergyIntolerance": allergies,
    "Observation": observations,
    "Immunization": immunizations,
    "Encounter": encounters,
    "Procedure": procedures,
    "DiagnosticReport": diagnostic_reports,
}


def typed_summary(resources: DataFrame) -> dict[str, DataFrame]:
    return {name: build(resources) for name, build in TYPED_TABLES.items()}
