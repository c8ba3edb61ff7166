"""Codeable concepts: display text, coding keys, summaries, system aliases and ranks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import blank_to_null, first_text, trimmed_or_null

CODING_TYPE = "struct<system:string,code:string,display:string>"
CONCEPT_TYPE = f"struct<text:string,coding:array<{CODING_TYPE}>>"

# Object identifiers of code systems.
OID_PREFIXES = {
    "2.16.840.1.113883.6.1": "loinc",
    "2.16.840.1.113883.6.8": "ucum",
    "2.16.840.1.113883.6.12": "cpt",
    "2.16.840.1.113883.6.69": "ndc",
    "2.16.840.1.113883.6.88": "rxnorm",
    "2.16.840.1.113883.6.96": "snomed",
    "2.16.840.1.113883.12.292": "cvx",
}
# Part of a code-system address -> prefix, first hit wins.
URL_PREFIXES = [
    ("rxnorm", "rxnorm"),
    ("loinc.org", "loinc"),
    ("snomed.info/sct", "snomed"),
    ("hl7.org/fhir/sid/cvx", "cvx"),
    ("hl7.org/fhir/sid/ndc", "ndc"),
    ("ama-assn.org/go/cpt", "cpt"),
    ("icd-10", "icd10cm"),
]
# Coding prefixes that decide a group, in order of preference.
TARGET_PREFIXES = {
    "MedicationRequest": ["rxnorm", "ndc"],
    "AllergyIntolerance": ["snomed"],
    "Condition": ["snomed", "icd10cm"],
    "Observation": ["loinc", "snomed", "cpt"],
    "Immunization": ["cvx"],
    "Encounter": ["snomed", "cpt"],
    "Procedure": ["snomed", "cpt"],
    "DiagnosticReport": ["loinc", "snomed", "cpt"],
}
# Spelling of a system in a coding key -> terminology system.
SYSTEM_ALIASES = {
    "loinc": "loinc", "lnc": "loinc",
    "rxnorm": "rxnorm", "rxnormn": "rxnorm",
    "icd10": "icd10cm", "icd10cm": "icd10cm", "icd10pcs": "icd10pcs",
    "snomed": "snomed", "snomedct": "snomed", "snomedct_us": "snomed",
    "cvx": "cvx", "cpt": "cpt", "hcpcs": "hcpcs",
}
# Terminology systems tried per record type, best first.
LOOKUP_SYSTEMS = {
    "MedicationRequest": ["rxnorm"],
    "AllergyIntolerance": ["snomed"],
    "Condition": ["icd10cm", "snomed"],
    "Observation": ["loinc", "snomed", "cpt", "hcpcs"],
    "Immunization": ["cvx"],
    "Encounter": ["snomed", "cpt", "hcpcs"],
    "Procedure": ["snomed", "cpt", "hcpcs", "icd10pcs"],
    "DiagnosticReport": ["loinc", "snomed", "cpt", "hcpcs"],
}
# Confidence per match type.
MATCH_CONFIDENCE = {
    "exact": 0.96, "same_cui": 0.94, "ingredient": 0.92, "group": 0.88, "first_axis": 0.84,
    "broader_ingredient": 0.84, "broader_group": 0.8, "broader": 0.76,
    "snomed_to_target_native_hierarchy": 0.72, "snomed_to_target_snomed_fallback": 0.68,
    "snomed_fallback": 0.64, "original": 0.5,
}
# Rank of a drug term type, lower is more specific.
TERM_TYPE_RANKS = {
    1: ["GPCK", "BPCK"],
    2: ["SCD", "SBD", "SCDGP", "SBDGP", "SCDFP", "SBDFP"],
    3: ["SCDG", "SBDG", "SCDF", "SBDF", "SCDC", "SBDC", "DFG"],
    4: ["MIN", "BN"],
    5: ["PIN", "IN"],
    6: ["DF", "TMSY", "ET"],
}


def literal_map(mapping: dict) -> Column:
    """A small constant lookup inside the projection: no join, stays in generated code."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def concept_text(concept: Column) -> Column:
    codings = concept["coding"]
    with_display = F.filter(codings, lambda c: blank_to_null(c["display"]).isNotNull())
    return F.coalesce(
        blank_to_null(concept["text"]),
        F.get(with_display, F.lit(0))["display"],
        F.get(codings, F.lit(0))["code"],
    )


def concept_code(concept: Column) -> Column:
    return F.get(F.filter(concept["coding"], lambda c: blank_to_null(c["code"]).isNotNull()), F.lit(0))["code"]


def coding_key(system: Column, code: Column) -> Column:
    """The system is put in lower case once. No identifier holds a part of an address, so the addresses, which are commoner, are tried first."""

    def keyed(lowered: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for part, name in URL_PREFIXES:
            out = out.when(F.contains(lowered, F.lit(part)), F.concat(F.lit(f"{name}:"), code))
        oid = F.regexp_extract(F.trim(F.coalesce(lowered, F.lit(""))), r"^(?:urn:oid:|oid:)?([0-2](?:\.\d+)+)$", 1)
        prefix = F.try_element_at(literal_map(OID_PREFIXES), oid)
        out = out.when(prefix.isNotNull(), F.concat(prefix, F.lit(":"), code)).when(oid != "", F.concat(F.lit("oid:"), oid, F.lit(":"), code))
        return out.when(blank_to_null(system).isNotNull(), F.concat(system, F.lit("|"), code)).otherwise(code)

    return F.get(F.transform(F.array(F.lower(system)), keyed), F.lit(0))


def authored_coding_key(system: Column, code: Column) -> Column:
    """Keys of patient-authored records know three systems only."""
    lowered = F.lower(F.coalesce(system, F.lit("")))
    return (
        F.when(F.contains(lowered, F.lit("rxnorm")), F.concat(F.lit("rxnorm:"), code))
        .when(F.contains(lowered, F.lit("hl7.org/fhir/sid/cvx")), F.concat(F.lit("cvx:"), code))
        .when(F.contains(lowered, F.lit("snomed.info/sct")), F.concat(F.lit("snomed:"), code))
        .when(blank_to_null(system).isNotNull(), F.concat(system, F.lit("|"), code))
        .otherwise(code)
    )


def coding_keys(concept: Column, key=coding_key) -> Column:
    """Distinct keys in first-seen order; never null."""
    coded = F.filter(F.coalesce(concept["coding"], F.array().cast(f"array<{CODING_TYPE}>")), lambda c: blank_to_null(c["code"]).isNotNull())
    return F.array_distinct(F.transform(coded, lambda c: key(c["system"], c["code"])))


def concept_codes(concept: Column) -> Column:
    """Bare distinct codes."""
    codings = F.coalesce(concept["coding"], F.array().cast(f"array<{CODING_TYPE}>"))
    return F.array_distinct(F.transform(F.filter(codings, lambda c: blank_to_null(c["code"]).isNotNull()), lambda c: c["code"]))


def coding_keys_of_all(concepts: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(concepts, lambda c: coding_keys(c))))


def concept_codings(concept: Column) -> Column:
    """Distinct (code, display) pairs that carry at least one of the two; null when there is no concept."""
    present = F.filter(
        F.coalesce(concept["coding"], F.array().cast(f"array<{CODING_TYPE}>")),
        lambda c: blank_to_null(c["code"]).isNotNull() | blank_to_null(c["display"]).isNotNull(),
    )
    return F.array_distinct(F.transform(present, lambda c: F.struct(c["code"].alias("code"), c["display"].alias("display"))))


def code_summary(concept: Column) -> Column:
    """STRUCT<text, codings>, or null when both are empty."""
    text, codings = trimmed_or_null(concept["text"]), concept_codings(concept)
    return F.when(text.isNotNull() | (F.size(codings) > 0), F.struct(text.alias("text"), codings.alias("codings")))


def first_concept_text(concepts: Column) -> Column:
    texts = F.filter(F.transform(concepts, concept_text), lambda t: blank_to_null(t).isNotNull())
    return F.get(texts, F.lit(0))


def first_concept_summary(concepts: Column) -> Column:
    return F.get(F.filter(F.transform(concepts, code_summary), lambda s: s.isNotNull()), F.lit(0))


def key_prefix(key: Column) -> Column:
    return F.lower(F.substring_index(key, ":", 1))


def target_coding_keys(resource_type: Column, ordered_keys: Column) -> Column:
    """Keys of the first preferred system that has any, out of sorted distinct keys; empty array otherwise."""
    preferred = F.try_element_at(
        F.create_map(*[x for rtype, prefixes in TARGET_PREFIXES.items() for x in (F.lit(rtype), F.array(*[F.lit(p) for p in prefixes]))]), resource_type
    )
    present = F.filter(preferred, lambda p: F.exists(ordered_keys, lambda k: key_prefix(k) == p))
    return F.coalesce(F.filter(ordered_keys, lambda k: key_prefix(k) == F.get(present, F.lit(0))), F.array().cast("array<string>"))


def parse_coding_key(key: Column) -> Column:
    """STRUCT<system, code> with aliases applied; null when the system is unknown or the code blank."""
    system = F.try_element_at(literal_map(SYSTEM_ALIASES), F.lower(F.substring_index(key, ":", 1)))
    code = F.trim(key.substr(F.instr(key, ":") + 1, F.length(key)))
    return F.when((F.instr(key, ":") > 1) & system.isNotNull() & (code != ""), F.struct(system.alias("system"), code.alias("code")))


def canonical_system(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(low.isin("lnc", "loinc"), "loinc")
        .when(low.isin("snomedct_us", "snomedct", "snomed"), "snomed")
        .when(low.isin("icd10cm", "icd-10", "icd10"), "icd10")
        .when(low.isin("rxnormn", "rxnorm"), "rxnorm")
        .otherwise(low)
    )


def lookup_system_rank(resource_type: Column, system: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for rtype, systems in LOOKUP_SYSTEMS.items():
        position = F.array_position(F.array(*[F.lit(s) for s in systems]), system)
        out = out.when(resource_type == rtype, F.when(position > 0, (position - 1).cast("int")).otherwise(len(systems) + 1))
    return out


def specificity_rank(system: Column, code: Column, tty: Column) -> Column:
    by_type = F.lit(99)
    for rank, types in TERM_TYPE_RANKS.items():
        by_type = F.when(tty.isin(*types), rank).otherwise(by_type)
    icd_length = F.length(F.concat(F.substring_index(code, ".", 1), F.when(F.instr(code, ".") > 0, code.substr(F.instr(code, ".") + 1, F.length(code))).otherwise("")))
    return (
        F.when((system == "rxnorm") & blank_to_null(tty).isNotNull(), by_type)
        .when(system == "icd10cm", F.lit(99) - icd_length)
        .otherwise(50)
    )


def match_confidence(match_type: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(MATCH_CONFIDENCE), match_type), F.lit(0.6))


def strength_rank(strength: Column) -> Column:
    return F.when(strength == "strong", 3).when(strength == "moderate", 2).otherwise(1)


def strength_name(rank: Column) -> Column:
    return F.when(rank == 3, "strong").when(rank == 2, "moderate").otherwise("weak")


def confidence_label_score(label: Column) -> Column:
    return F.when(label == "high", 0.9).when(label == "medium", 0.6).when(label == "low", 0.3).otherwise(0.0)


def code_prefixes(code: Column) -> Column:
    """The code, then shorter forms: E11.901, E11.90, E11.9, E11."""
    clean = F.upper(F.regexp_replace(F.trim(code), r"\s+", ""))
    dot = F.instr(clean, ".")
    lengths = F.sequence(F.length(clean), F.when(dot > 0, dot + 1).otherwise(F.length(clean)), F.lit(-1))
    longer = F.transform(lengths, lambda n: clean.substr(F.lit(1), n))
    return F.when(dot == 0, F.array(clean)).when(dot == F.length(clean), F.array(clean)).otherwise(F.concat(longer, F.array(F.substring_index(clean, ".", 1))))


def category_parent(code: Column) -> Column:
    """Three-character category of a dotted code, else null."""
    return F.when(code.rlike(r"^[A-Z]\d{2}\."), F.substring(code, 1, 3))


def text_or_label(summary: Column, label: Column) -> Column:
    return F.array(first_text(summary["text"], label))
