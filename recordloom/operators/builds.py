"""Batch jobs that build the terminology and association tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.coding import literal_map
from ..functions.ranking import extreme_row, one_or_several
from ..functions.text import norm_name, norm_text, squash_spaces, title_letters

# Source abbreviation -> terminology system.
SOURCE_SYSTEMS = {"LNC": "loinc", "RXNORM": "rxnorm", "ICD10CM": "icd10cm", "SNOMEDCT_US": "snomed", "CVX": "cvx", "CPT": "cpt", "HCPCS": "hcpcs"}
# Trust in the source of a friendly name, and in how it was matched.
FRIENDLY_SCORES = {"MEDLINEPLUS": 100, "CHV": 95, "RXNORM": 85, "CVX": 85, "LNC": 70, "SNOMEDCT_US": 70, "ICD10CM": 70, "CPT": 65, "HCPCS": 65}
MATCH_SCORES = {
    "exact": 100, "same_cui": 95, "ingredient": 92, "group": 88, "first_axis": 84, "broader_ingredient": 82, "broader_group": 78,
    "broader": 72, "snomed_to_target_native_hierarchy": 68, "snomed_to_target_snomed_fallback": 64, "snomed_fallback": 60,
}
UNKNOWN_MATCH_SCORE = 20
# Conditions without a useful list of medications.
SKIPPED_CONDITIONS = ("Cancer", "Fractures", "Long-term Anticoagulant Therapy", "Clavicle Fracture", "Mandibular Fracture", "Pregnancy")
# Condition name -> code prefixes that stand for it, in order.
CONDITION_ALIASES = {
    "Acute Myocardial Infarction": [("SNOMEDCT_US", "84114007"), ("ICD10CM", "I21"), ("ICD10CM", "I22")],
    "Breast Cancer": [("SNOMEDCT_US", "254837009"), ("ICD10CM", "C50")],
    "COPD": [("SNOMEDCT_US", "13645005"), ("ICD10CM", "J44")],
    "Chronic Back Pain": [("SNOMEDCT_US", "279039007"), ("ICD10CM", "M54.5")],
    "Chronic Hepatitis B": [("SNOMEDCT_US", "419343005"), ("ICD10CM", "B18.1")],
    "Colon Cancer": [("SNOMEDCT_US", "363406005"), ("ICD10CM", "C18")],
    "Colon Polyps": [("SNOMEDCT_US", "68496003"), ("ICD10CM", "K63.5")],
    "Diabetes Type 2": [("SNOMEDCT_US", "44054006"), ("ICD10CM", "E11")],
    "Diabetic Kidney Disease": [("SNOMEDCT_US", "127013003"), ("ICD10CM", "E11.2"), ("ICD10CM", "E13.2")],
    "Lung Cancer": [("SNOMEDCT_US", "363358000"), ("ICD10CM", "C34")],
    "Metabolic Syndrome": [("SNOMEDCT_US", "237602007"), ("ICD10CM", "E88.81")],
    "Prostate Cancer": [("SNOMEDCT_US", "399068003"), ("ICD10CM", "C61")],
    "Strep Throat": [("SNOMEDCT_US", "186351002"), ("ICD10CM", "J02.0")],
    "Thyroid Disease": [("SNOMEDCT_US", "40930008"), ("ICD10CM", "E03"), ("ICD10CM", "E05")],
    "Vitamin D Deficiency": [("SNOMEDCT_US", "429280009"), ("ICD10CM", "E55.9")],
}


def may_treat(rows: DataFrame, max_depth: int = 2) -> DataFrame:
    depth = F.col("match_depth").try_cast("int")
    return rows.filter((F.col("relationship_type") == "may_treat") & (depth <= max_depth))


def changed_names(rows: DataFrame) -> DataFrame:
    """Rows whose friendly name says something else than the technical one."""
    return rows.filter(norm_text(F.col("name")) != norm_text(F.col("technical_name")))


def best_lookup_rows(rows: DataFrame, friendly_sources: list[str] | None = None) -> DataFrame:
    """Best friendly name per (system, code) by source, match, depth and name."""
    kept = rows.withColumn("system", F.try_element_at(literal_map(SOURCE_SYSTEMS), F.col("source"))).withColumns({"code": F.trim("code"), "name": F.trim("name")})
    kept = kept.filter("system is not null and code <> '' and name <> ''")
    if friendly_sources:
        kept = kept.filter(F.col("friendly_source").isin(*friendly_sources))
    scored = changed_names(kept).select(
        "system",
        "code",
        F.coalesce(F.try_element_at(literal_map(FRIENDLY_SCORES), F.col("friendly_source")), F.lit(0)).alias("_source"),
        F.coalesce(F.try_element_at(literal_map(MATCH_SCORES), F.col("match_type")), F.lit(UNKNOWN_MATCH_SCORE)).alias("_match"),
        F.coalesce(-F.col("match_depth").try_cast("int"), F.lit(0)).alias("_depth"),
        "name",
        F.coalesce(F.trim("friendly_source"), F.lit("")).alias("friendly_source"),
        F.coalesce(F.trim("match_type"), F.lit("")).alias("match_type"),
    )
    return extreme_row(scored, ["system", "code"], ["_source", "_match", "_depth", "name"]).drop("_source", "_match", "_depth")


def first_canonical_codes(rows: DataFrame) -> DataFrame:
    """First code per normalised name and category; ``input_pos`` gives the order."""
    kept = rows.filter("category in ('condition', 'lab', 'medication') and friendly_name <> '' and canonical_code <> ''")
    keyed = kept.withColumn("norm_name", norm_name(F.col("friendly_name")))
    return keyed.groupBy("category", "norm_name").agg(F.min_by("canonical_code", "input_pos").alias("code"))


def shortest_technical_names(rows: DataFrame) -> DataFrame:
    """One coding option per code: the shortest technical name, the earlier one on a tie."""
    system = F.try_element_at(literal_map({"RXNORM": "rxnorm", "CVX": "cvx"}), F.col("source"))
    tidy = rows.select(system.alias("system"), squash_spaces(F.col("code")).alias("code"), squash_spaces(F.col("name")).alias("name"), squash_spaces(F.col("technical_name")).alias("technical_name"), "input_pos")
    kept = tidy.filter("system is not null and code <> '' and name <> '' and technical_name <> ''").withColumn("_len", F.length("technical_name"))
    return extreme_row(kept, ["system", "code"], ["_len", "input_pos"], "min").drop("_len", "input_pos")


def depth_strength(depth: Column) -> Column:
    return F.when(depth.between(0, 1), "strong").when(depth == 2, "moderate").when(depth.between(3, 4), "weak")


def strength_from_depth(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Best strength per pair; depth five and more is dropped."""
    depth = F.col("match_depth").try_cast("int")
    best = rows.withColumn("_d", depth).filter("_d between 0 and 4").groupBy(*keys).agg(F.min("_d").alias("match_depth"))
    return best.withColumn("strength", depth_strength(F.col("match_depth")))


def medication_title(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "/"), lambda p: title_letters(F.trim(p))), " / ")


def condition_medications(rows: DataFrame, targets: DataFrame, aliases: DataFrame, skipped: tuple[str, ...] = SKIPPED_CONDITIONS) -> DataFrame:
    """Distinct ``(condition_name, medication)`` pairs.

    ``targets(condition_name, target_pos)``, ``aliases(condition_name, source, prefix, alias_pos)``. The exact name is
    tried first; the rows it does not know are matched by code prefix. Codes are short, so every prefix of
    a code is generated and the prefix match becomes an equi join; the first alias wins.
    """
    base = may_treat(rows).select(medication_title(F.col("medication_name")).alias("medication"), "condition_source", "condition_code", F.lower("condition_name").alias("_low")).distinct()
    usable = targets.filter(~F.col("condition_name").isin(*skipped)).groupBy(F.lower("condition_name").alias("_low")).agg(F.min_by("condition_name", "target_pos").alias("condition_name"))
    exact = base.join(usable, "_low").select("condition_name", "medication")
    rest = base.join(usable, "_low", "left_anti")
    codes = rest.select("condition_source", "condition_code").distinct()
    prefixes = codes.withColumn("_prefix", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("condition_code"), F.lit(1))), lambda n: F.col("condition_code").substr(F.lit(1), n))))
    hit = prefixes.join(aliases.select("condition_name", F.col("source").alias("condition_source"), F.col("prefix").alias("_prefix"), "alias_pos"), ["condition_source", "_prefix"])
    first = hit.groupBy("condition_source", "condition_code").agg(F.min_by("condition_name", "alias_pos").alias("condition_name"))
    by_code = rest.join(first, ["condition_source", "condition_code"]).select("condition_name", "medication")
    named = exact.unionByName(by_code).distinct()
    return named.join(targets.filter(~F.col("condition_name").isin(*skipped)).select("condition_name"), "condition_name", "left_semi")


def relationship_totals(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("condition_name").agg(F.count(F.lit(1)).alias("n_medications"), F.min("medication").alias("first_medication"), F.max("medication").alias("last_medication"))


_BORDER = r"[\s\-/,&]"


def match_causes(sequelae: DataFrame, causes: DataFrame, name: str = "sequela", cause: str = "cause") -> DataFrame:
    """Longest cause that stands in a name between blanks, dashes, slashes, commas, ampersands or its ends.

    Only the first occurrence of a cause is looked at. Both sides are cut into words at the border characters and
    joined on the rarest word of the cause, then verified; no nested loop over names and causes.
    """
    flat = F.lower(F.trim(F.regexp_replace(F.col(name), r"\s+", " ")))
    words = lambda c: F.array_distinct(F.filter(F.split(c, _BORDER), lambda w: w != ""))
    names = sequelae.select(F.col(name)).distinct().withColumn("_flat", flat).filter("_flat <> ''")
    c = causes.select(F.col(cause)).distinct().withColumn("_low", F.lower(cause)).filter("_low <> ''")
    spread = c.select(cause, "_low", F.explode(words(F.col("_low"))).alias("_word"))
    freq = spread.groupBy("_word").agg(F.count(F.lit(1)).alias("_df"))
    rare = extreme_row(spread.join(freq, "_word").select(cause, "_low", "_df", "_word"), [cause, "_low"], ["_df", "_word"], "min").select(cause, "_low", "_word")
    hits = names.select(name, "_flat", F.explode(words(F.col("_flat"))).alias("_word")).join(rare, "_word").withColumn("_at", F.expr("instr(_flat, _low)")).filter("_at > 0")
    before = F.when(F.col("_at") > 1, F.expr("substring(_flat, _at - 1, 1)")).otherwise(F.lit(""))
    after = F.expr("substring(_flat, _at + length(_low), 1)")
    free = lambda ch: (ch == "") | ch.rlike(_BORDER)
    good = hits.filter((F.col("_flat") == F.col("_low")) | (free(before) & free(after)))
    return good.groupBy(name).agg(F.max_by(cause, F.struct(F.length("_low"), F.col(cause))).alias(cause))


def nearest_coded_ancestor(causes: DataFrame, coded: DataFrame, cause: str = "cause") -> DataFrame:
    """The cause itself if it has codes, else the longest coded cause that is a word prefix of it."""
    parts = F.split(F.col(cause), " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), " "))
    rows = causes.select(cause, F.explode(prefixes).alias("ancestor"))
    known = rows.join(coded.select(F.col(cause).alias("ancestor")).distinct(), "ancestor")
    return known.groupBy(cause).agg(F.max_by("ancestor", F.length("ancestor")).alias("ancestor"))


def codes_of_token(token: Column) -> Column:
    """The codes that a token of ``expand_code_ranges`` stands for."""
    shape = r"^([A-Z])(\d{2})(\d{1,2})?$"
    part = lambda c, i: F.regexp_extract(c, shape, i)
    sub = lambda c: F.substring(F.rpad(part(c, 3), 2, "0"), 1, 2).try_cast("int")
    a, b = (F.trim(F.split_part(token, F.lit("-"), F.lit(n))) for n in (1, 2))
    # Values that several later expressions need are bound as fields of one element.
    ends = F.array(F.struct(a.alias("a"), b.alias("b"), part(a, 1).alias("letter"), part(b, 1).alias("other"), part(a, 2).try_cast("int").alias("lo"), part(b, 2).try_cast("int").alias("hi"), F.coalesce(sub(a), F.lit(0)).alias("first"), F.coalesce(sub(b), F.lit(9)).alias("last")))
    none = F.array().cast("array<string>")

    def base_codes(e: Column, n: Column) -> Column:
        stem = F.concat(e["letter"], F.lpad(n.cast("string"), 2, "0"))
        first, last = F.when(n == e["lo"], e["first"]).otherwise(0), F.when(n == e["hi"], e["last"]).otherwise(9)
        subs = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: (d >= first) & (d <= last))
        return F.concat(F.array(stem), F.transform(subs, lambda d: F.concat(stem, F.lit("."), d.cast("string"))))

    def range_codes(e: Column) -> Column:
        ranged = F.when(e["lo"] <= e["hi"], F.flatten(F.transform(F.sequence(e["lo"], e["hi"]), lambda n: base_codes(e, n)))).otherwise(none)
        return F.when((e["letter"] != "") & (e["letter"] == e["other"]), ranged).otherwise(F.filter(F.array(e["a"], e["b"]), lambda c: c != ""))

    return F.when(F.instr(token, "-") == 0, F.array(token)).otherwise(F.flatten(F.transform(ends, range_codes)))


def expand_code_ranges(rows: DataFrame, keys: list[str], cell: str = "codes") -> DataFrame:
    """Codes of a cell such as ``A50-A529, I980``: ranges inside one letter become bases and one-digit subcodes.

    A cell's codes are made distinct inside its row; only keys that hold several cells need an exchange of their codes.
    """
    tokens = F.array_distinct(F.filter(F.transform(F.split(F.col(cell), "[;,]"), lambda t: F.upper(F.trim(t))), lambda t: t.rlike(r"^[A-Z]\d")))
    codes = F.array_distinct(F.flatten(F.transform(tokens, codes_of_token)))
    one, several = one_or_several(rows, keys, cell)
    listed = lambda df: df.select(*keys, F.explode(codes).alias("code"))
    return listed(one).unionByName(listed(several).distinct())


def code_weights(matched: DataFrame, cause_codes: DataFrame) -> DataFrame:
    """Largest weight per cause, then per code: ``matched(cause, weight)``, ``cause_codes(cause, code)``."""
    per_cause = matched.groupBy("cause").agg(F.max("weight").alias("weight"))
    return per_cause.join(cause_codes, "cause").groupBy("code").agg(F.max("weight").alias("weight"))


def build_weights(sequelae: DataFrame, cause_table: DataFrame) -> DataFrame:
    """``sequelae(sequela, health_state, weight)``, ``cause_table(cause, codes)`` -> ``(code, weight)``."""
    causes = cause_table.select(F.trim("cause").alias("cause"), F.col("codes")).filter("cause <> '' and lower(cause) <> 'cause'")
    usable = sequelae.filter("weight is not null and not isnan(weight) and trim(sequela) <> ''").filter(~F.contains(F.lower(F.coalesce("health_state", F.lit(""))), F.lit("combined dw")))
    matched = usable.join(match_causes(usable, causes), "sequela").select("cause", "weight")
    codes = expand_code_ranges(causes, ["cause"])
    owners = nearest_coded_ancestor(matched.select("cause").distinct(), codes)
    inherited = owners.join(codes.withColumnRenamed("cause", "ancestor"), "ancestor").select("cause", "code")
    return code_weights(matched, inherited)


def crosswalk(concept_codes: DataFrame) -> DataFrame:
    """``(concept_id, system, code)`` -> shortest ICD-10 code of the concept for each code; own code for ICD-10, else null."""
    icd = concept_codes.filter("system = 'icd10cm'").groupBy("concept_id").agg(F.min(F.struct(F.length("code").alias("n"), F.col("code")))["code"].alias("_icd"))
    rows = concept_codes.join(icd, "concept_id", "left").select("system", "code", F.when(F.col("system") == "icd10cm", F.col("code")).otherwise(F.col("_icd")).alias("icd10_code"))
    return rows.groupBy("system", "code").agg(F.min(F.when(F.col("icd10_code").isNotNull(), F.struct(F.length("icd10_code").alias("n"), F.col("icd10_code")))).alias("_k")).select("system", "code", F.col("_k.icd10_code").alias("icd10_code"))


def pick_friendly_names(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(concept_id, name, friendly_source)`` -> the chosen name per concept, and the other names as aliases."""
    ranked = names.select("concept_id", (F.col("friendly_source") != "MEDLINEPLUS").alias("_other"), F.length("name").alias("_len"), "name")
    chosen = ranked.groupBy("concept_id").agg(F.min(F.struct("_other", "_len", "name"))["name"].alias("name"))
    aliases = names.select("concept_id", F.col("name").alias("alias")).distinct().join(chosen, "concept_id").filter("alias <> name").select("concept_id", "alias")
    return chosen, aliases
