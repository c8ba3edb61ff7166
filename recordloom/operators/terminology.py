"""Joins against terminology and association tables. All tables are DataFrame arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.coding import (
    code_prefixes,
    lookup_system_rank,
    match_confidence,
    parse_coding_key,
    specificity_rank,
    strength_name,
    strength_rank,
)
from ..functions.ranking import best_row, dealt, extreme_row, fan_out, one_or_several, repeated, slots_of
from ..functions.text import meaningful_tokens, norm_name, norm_text
from ..session import saved

STRINGS = "array<string>"


def _tokens_of_all(values: Column) -> Column:
    return F.flatten(F.transform(F.coalesce(values, F.array().cast(STRINGS)), lambda v: meaningful_tokens(v)))


def name_matches_source(name: Column, ingredient_tokens: Column, source_tokens: Column) -> Column:
    """A medication name must share a meaningful token with the ingredients, else with the source text."""
    tokens = meaningful_tokens(name)
    return (
        F.when(F.size(ingredient_tokens) > 0, F.arrays_overlap(ingredient_tokens, tokens))
        .when(F.size(source_tokens) == 0, True)
        .otherwise(F.arrays_overlap(source_tokens, tokens))
    )


def safety_tokens(df: DataFrame) -> DataFrame:
    """Add the token arrays that ``name_matches_source`` compares (empty for non-medications)."""
    is_med = F.col("resource_type") == "MedicationRequest"
    displays = F.transform(F.coalesce(F.col("code_codings"), F.array().cast("array<struct<code:string,display:string>>")), lambda c: c["display"])
    source = F.concat(F.array("source_label"), F.coalesce(F.col("code_texts"), F.array().cast(STRINGS)), displays)
    none = F.array().cast(STRINGS)
    return df.withColumns(
        {
            "_ingredient_tokens": F.when(is_med, _tokens_of_all(F.col("ingredients"))).otherwise(none),
            "_source_tokens": F.when(is_med, _tokens_of_all(source)).otherwise(none),
        }
    )


def friendly_names(concepts: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Best terminology entry per concept: system rank, specificity, match confidence, then key order.

    ``keys`` name one concept. Concepts that carry the same codes, and as medications the same words, have the same entry: it is found once
    for all of them, under 128 bits of a hash of what they carry. So what is exchanged per concept is its keys and that hash, not every code with its entry.
    The join is an equality on (system, code). ``terms`` is not hinted: Spark broadcasts it while its
    measured size is small and sorts otherwise.
    """
    words = ["ingredients", "source_label", "code_texts", "code_codings"]
    read = concepts.select(*keys, "resource_type", "coding_keys", *[F.when(F.col("resource_type") == "MedicationRequest", F.col(c)).alias(c) for c in words])
    content = ["resource_type", "coding_keys", *words]
    # Never null, so that no filter on it keeps the two readers of ``marked`` from sharing an exchange.
    marked = read.withColumn("_concept", F.coalesce(F.unhex(F.md5(F.to_json(F.struct(*content)))), F.lit(b"")))
    rows = safety_tokens(marked.select("_concept", *content).distinct()).select("_concept", "resource_type", "_ingredient_tokens", "_source_tokens", F.posexplode("coding_keys").alias("key_pos", "_key"))
    parsed = rows.withColumn("_p", parse_coding_key(F.col("_key"))).filter("_p is not null").select("*", F.col("_p.system").alias("system"), F.col("_p.code").alias("code")).drop("_p", "_key")
    found = parsed.join(terms, ["system", "code"]).filter(
        (F.col("resource_type") != "MedicationRequest") | name_matches_source(F.col("name"), F.col("_ingredient_tokens"), F.col("_source_tokens"))
    )
    ranked = found.select(
        "_concept", "system", "code", "name", "match_type", "canonical_system", "canonical_code",
        lookup_system_rank(F.col("resource_type"), F.col("system")).alias("_system"),
        specificity_rank(F.col("system"), F.col("code"), F.col("tty")).alias("_specific"),
        match_confidence(F.col("match_type")).alias("_conf"),
        "key_pos",
    )
    best = best_row(ranked, ["_concept"], [F.col("_system"), F.col("_specific"), F.col("_conf").desc(), F.col("key_pos")])
    blank = norm_text(F.col("name")) == ""
    entries = best.select(
        "_concept", "system", "code", "name", "match_type", "canonical_system", "canonical_code",
        F.when(blank, 0.5).otherwise(F.col("_conf")).alias("confidence"), blank.alias("fallback"),
    )
    return marked.select(*keys, "resource_type", "_concept").join(entries, "_concept").drop("_concept")


# Category of a group -> code system of its canonical code.
CANONICAL_SYSTEMS = {"condition": "icd10", "lab": "loinc", "medication": "rxnorm"}


def canonical_category(resource_types: Column) -> Column:
    has = lambda t: F.array_contains(resource_types, t)
    return F.when(has("Condition"), "condition").when(has("Observation"), "lab").when(has("MedicationRequest"), "medication")


def canonical_codes(groups: DataFrame, table: DataFrame) -> DataFrame:
    """Canonical code of a group by its strictly normalised name, ``table(category, norm_name, code)``."""
    keyed = groups.withColumns({"category": canonical_category(F.col("resource_types")), "norm_name": norm_name(F.col("name"))})
    system = F.create_map(*[F.lit(x) for kv in CANONICAL_SYSTEMS.items() for x in kv])
    joined = keyed.join(table.select("category", "norm_name", F.col("code").alias("canonical_code")), ["category", "norm_name"], "left")
    return joined.withColumn("canonical_system", F.when(F.col("canonical_code").isNotNull(), F.try_element_at(system, F.col("category")))).drop("norm_name")


def decompose(products: DataFrame, ingredients: DataFrame, code: str = "code") -> DataFrame:
    """Ingredients of each product code; unknown products give no row."""
    return products.join(ingredients.withColumnRenamed("product_code", code), code)


def condition_partners(conditions: DataFrame, assoc: DataFrame, min_strength: str = "moderate") -> DataFrame:
    """Labs or medications of a condition code that are at least ``min_strength``."""
    floor = {"strong": 3, "moderate": 2}.get(min_strength, 1)
    return conditions.join(assoc.filter(strength_rank(F.col("strength")) >= floor), "condition_code")


def medication_conditions(medications: DataFrame, ingredients: DataFrame, assoc_meds: DataFrame, keys: list[str]) -> DataFrame:
    """Conditions of a medication with the best strength.

    ``medications(keys, code, given ARRAY)``: the given ingredient codes, else those the product breaks down
    to, else the code itself. Medications of the same ingredients share their conditions, which are found once per set of ingredients.
    """
    given = medications.filter(F.size(F.coalesce("given", F.array().cast(STRINGS))) > 0).select(*keys, F.explode("given").alias("ingredient_code"))
    rest = medications.filter(F.size(F.coalesce("given", F.array().cast(STRINGS))) == 0).select(*keys, "code")
    parts = ingredients.select(F.col("product_code").alias("code"), "ingredient_code")
    broken = rest.join(parts, "code", "left").select(*keys, F.coalesce("ingredient_code", "code").alias("ingredient_code"))
    # A set is exchanged once per medication; from there on 128 bits of its hash stand for it.
    gathered = given.unionByName(broken).groupBy(*keys).agg(F.sort_array(F.collect_set("ingredient_code")).alias("_parts")).filter(F.size("_parts") > 0)
    hashed = saved(gathered.withColumn("_set", F.unhex(F.md5(F.to_json("_parts")))))
    sets = hashed.groupBy("_set").agg(F.count(F.lit(1)).alias("_rows"), F.any_value("_parts").alias("_parts"))
    slots, mixed = slots_of(F.col("_rows")), F.size("_parts") > 1
    per_code = assoc_meds.groupBy(F.col("code").alias("ingredient_code"), "condition_code").agg(F.max(strength_rank(F.col("strength"))).alias("_s"), F.min("condition_pos").alias("assoc_pos"))

    def conditions_of(kind: Column) -> DataFrame:
        codes = repeated(sets.filter(kind), slots).select("_set", "_slot", F.explode("_parts").alias("ingredient_code"))
        return codes.join(per_code, "ingredient_code").drop("ingredient_code")

    def pairs(conditions: DataFrame, kind: Column) -> DataFrame:
        members = hashed.filter(kind).select(*keys, "_set").join(sets.select("_set", "_rows"), "_set")
        return conditions.join(dealt(members, ["_set", "_rows"], slots).drop("_rows"), ["_set", "_slot"])

    # One exchange serves the best strength within a mixed set and its join with the medications.
    best_of_set = conditions_of(mixed).repartition("_set", "_slot").groupBy("_set", "_slot", "condition_code").agg(F.max("_s").alias("_s"), F.min("assoc_pos").alias("assoc_pos"))
    best = pairs(conditions_of(~mixed), ~mixed).unionByName(pairs(best_of_set, mixed))
    return best.select(*keys, "condition_code", strength_name(F.col("_s")).alias("strength"), "assoc_pos")


def lab_conditions(labs: DataFrame, assoc_labs: DataFrame, keys: list[str]) -> DataFrame:
    """Conditions of a lab code with the strength listed first.

    They are picked once per code, so labs of one code are joined to the picks and need no exchange of the result.
    """
    first = assoc_labs.groupBy("code", "condition_code").agg(F.min_by("strength", "pos").alias("strength"), F.min("pos").alias("pos"))
    one, several = one_or_several(labs, keys, "code")
    picked = fan_out(several, first, ["code"]).groupBy(*keys, "condition_code").agg(F.min_by("strength", "pos").alias("strength"))
    return fan_out(one, first, ["code"]).select(*keys, "condition_code", "strength").unionByName(picked)


def reverse_pairs(pairs: DataFrame, lower: bool = False) -> DataFrame:
    """Distinct related name -> condition name rows of ``pairs(condition_name, related_name)``."""
    related = F.lower("related_name") if lower else F.col("related_name")
    return pairs.select(related.alias("related_name"), "condition_name").distinct()


def lab_name_conditions(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact-name lookup."""
    return names.join(reverse_pairs(pairs), names["name"] == F.col("related_name")).drop("related_name")


def whole_word_candidates(texts: DataFrame, phrases: DataFrame, keys: list[str], text: str, phrase: str) -> DataFrame:
    """Texts that contain a phrase between non-alphanumeric characters or the ends of the text.

    No nested loop: every phrase is looked up by one of its tokens, the one that occurs in the fewest
    phrases (longer first, then binary order), then the hit is verified on the whole text. A phrase
    without any letter or digit cannot be a name and is left out.
    """
    token = lambda c: F.array_distinct(F.filter(F.split(c, "[^a-z0-9]+"), lambda t: t != ""))
    p = phrases.select(F.col(phrase).alias("_phrase")).distinct().filter("_phrase <> ''")
    spread = p.select("_phrase", F.explode(token(F.col("_phrase"))).alias("_token"))
    freq = spread.groupBy("_token").agg(F.count(F.lit(1)).alias("_df"))
    rare = extreme_row(spread.join(freq, "_token").select("_phrase", "_df", (-F.length("_token")).alias("_len"), "_token"), ["_phrase"], ["_df", "_len", "_token"], "min").select("_phrase", "_token")
    words = texts.select(*keys, F.explode(token(F.col(text))).alias("_token"))
    hits = words.join(rare, "_token").select(*keys, "_phrase").distinct()
    quoted = F.replace(F.col("_phrase"), F.lit(r"\E"), F.lit(r"\E\\E\Q"))  # a phrase may hold the mark that ends a quotation
    at_border = F.concat(F.lit(r"(?:^|[^a-z0-9])\Q"), quoted, F.lit(r"\E(?:[^a-z0-9]|$)"))
    # The text itself only meets its few candidates; ``keys`` name one text each.
    verified = hits.join(texts.select(*keys, F.col(text).alias("_text") if text not in keys else F.lit(None).alias("_unused")), keys)
    whole = F.col("_text") if text not in keys else F.col(text)
    return verified.filter(F.contains(whole, F.col("_phrase"))).filter(F.regexp_like(whole, at_border)).select(*keys, F.col("_phrase").alias(phrase))


def medication_name_conditions(meds: DataFrame, codes: DataFrame, ingredients: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Conditions of a medication name in three tiers; the first tier with a hit wins.

    ``meds(keys, name)``, ``codes(keys, code)``. Conditions are found once per code and per name that no code told; medications are
    joined to them at the end. Only those with several codes or names need an exchange of what they found.
    """
    index = reverse_pairs(pairs, lower=True)
    products = ingredients.select(F.col("product_code").alias("code"), F.lower("ingredient_name").alias("related_name"))
    per_code = saved(codes.select("code").distinct().join(products, "code").join(index, "related_name").select("code", "condition_name").distinct())
    told = codes.join(per_code.select("code").distinct(), "code", "left_semi").select(*keys).distinct()
    left1 = meds.join(told, keys, "left_anti").select(*keys, "name")
    names = saved(left1.select("name").distinct())
    parts = names.select("name", F.explode(F.split("name", r"\s*/\s*")).alias("_part")).select("name", F.lower(F.trim("_part")).alias("related_name"))
    per_part = saved(parts.join(index, "related_name").select("name", "condition_name").distinct())
    left2 = names.join(per_part.select("name").distinct(), "name", "left_anti").withColumn("_low", F.lower("name"))
    contained = whole_word_candidates(left2.select("_low").distinct(), index, ["_low"], "_low", "related_name")
    per_word = left2.join(contained, "_low").join(index, "related_name").select("name", "condition_name").distinct()
    tag = lambda df, n: df.withColumn("tier", F.lit(n))
    per_name = saved(tag(per_part, 2).unionByName(tag(per_word, 3)))
    cols = [*keys, "condition_name", "tier"]
    one_code, several_codes = one_or_several(codes, keys, "code")
    one_name, several_names = one_or_several(left1, keys, "name")
    by_code = fan_out(one_code, per_code, ["code"]).select(*keys, "condition_name").unionByName(fan_out(several_codes, per_code, ["code"]).select(*keys, "condition_name").distinct())
    by_names = fan_out(several_names, per_name, ["name"]).select(*cols).distinct()
    first = by_names.join(by_names.groupBy(*keys).agg(F.min("tier").alias("tier")), [*keys, "tier"], "left_semi")
    return tag(by_code, 1).unionByName(fan_out(one_name, per_name, ["name"]).select(*cols)).unionByName(first.select(*cols))


def weights_by_code(codes: DataFrame, weights: DataFrame, code: str = "code") -> DataFrame:
    """Weight of the longest known prefix form of a code, 0 if none.

    Distinct codes are expanded once; the prefixes turn the fallback into an equi join.
    """
    distinct = codes.select(F.col(code).alias("_code")).distinct().filter("_code is not null")
    expanded = distinct.select("_code", F.posexplode(code_prefixes(F.col("_code"))).alias("_pos", "_prefix"))
    usable = weights.filter("weight is not null and not isnan(weight)").select(F.col("code").alias("_prefix"), "weight")
    best = expanded.join(usable, "_prefix").groupBy("_code").agg(F.min_by("weight", "_pos").alias("_w"))
    return codes.join(best, codes[code] == best["_code"], "left").drop("_code").withColumn("weight", F.coalesce("_w", F.lit(0.0))).drop("_w")


def weights_by_keys(records: DataFrame, weights: DataFrame, keys: list[str], coding_keys: str = "coding_keys") -> DataFrame:
    """Weight of the first ICD-10 coding key whose weight is positive, 0 if none."""
    rows = records.select(*keys, F.posexplode(coding_keys).alias("_key_pos", "_key"))
    icd = rows.filter(F.lower(F.substring_index("_key", ":", 1)).isin("icd10", "icd10cm") & (F.instr("_key", ":") > 1))
    coded = icd.withColumn("_icd", F.expr("substring(_key, instr(_key, ':') + 1)"))
    weighed = weights_by_code(coded, weights, "_icd").filter("weight > 0")
    best = weighed.groupBy(*keys).agg(F.min_by("weight", "_key_pos").alias("_w"))
    return records.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce("_w", F.lit(0.0)).alias("weight"))
