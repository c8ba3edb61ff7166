"""Checked queries for compaction and grouping, over parts as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import grouping, records, state
from .registry import Tables, pick, register, sql_pick, text

TYPES = ("MedicationRequest", "Condition", "Observation", "Encounter")


def part_records(t: Tables) -> DataFrame:
    """Parts as records of 50 patients: coded, keyed, labelled and with ingredients, by part key."""
    k = F.col("p_partkey")
    size = text("p_size")
    keys = (
        F.when(k % 5 == 0, F.array(F.concat(F.lit("snomed:"), size), F.concat(F.lit("loinc:"), size), F.concat(F.lit("rxnorm:"), size)))
        .when(k % 5 == 1, F.array(F.concat(F.lit("http://x|"), "p_type")))
        .otherwise(F.array().cast("array<string>"))
    )
    return records.as_records(
        t.part, patient_id=text(k % 50), input_pos=k, id=F.concat(F.lit("r"), text(k)), resource_type=pick(k % 4, *TYPES), source_label=F.concat(F.lit(" "), "p_name"), status=F.lit("active"),
        category=pick(k % 3, "Laboratory", "Imaging Study", None), date=F.concat(F.lit("20"), F.lpad(size, 2, "0"), F.lit("-01-01")), coding_keys=keys, code_texts=F.array("p_name"),
        code_codings=F.array(F.struct(F.col("p_type").alias("code"), F.col("p_brand").alias("display"))), ingredients=F.when((k % 4 == 0) & (k % 3 == 0), F.array(F.col("p_type"), F.lit("zinc"))),
        route=F.when(k % 24 == 0, "Oral"), source=F.when(k % 41 == 0, "patient").otherwise("provider"), hidden=k % 17 == 0, inactive_overlay=k % 29 == 0, grouping_text=F.concat_ws(" ", "p_name", "p_brand"),
    )


#: The same ids in SQL.
STEM_SQL = (
    "CASE WHEN length({s}) BETWEEN 1 AND 60 AND {s} = {w} THEN {s} ELSE concat_ws('-', nullif(substr({s}, 1, 60), ''), substr(sha256(coalesce(nullif({w}, ''), coalesce({x}, ''))), 1, 32)) END"
)


def stem_sql(x: str) -> str:
    dashed = "regexp_replace(regexp_replace(lower(coalesce(" + x + ", '')), '[^{}]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return STEM_SQL.format(s=dashed.format("a-z0-9"), w=dashed.format("\\p{L}\\p{M}\\p{N}"), x=x)


# Words of the keys, written out for the SQL side.
PART_SQL = f"""
b AS (
  SELECT p_partkey AS k, CAST(p_partkey % 50 AS VARCHAR) AS patient_id, 'r' || p_partkey AS id, {sql_pick('p_partkey % 4', *TYPES)} AS t, p_name, p_type, p_brand, p_size,
    {sql_pick('p_partkey % 3', 'Laboratory', 'Imaging Study', None)} AS category, p_partkey % 4 = 0 AND p_partkey % 3 = 0 AS ing, p_partkey % 24 = 0 AS routed, lower(p_type) AS pt
  FROM part WHERE p_partkey % 17 <> 0),
tk AS (SELECT *, CASE WHEN k % 5 = 0 THEN CASE t WHEN 'MedicationRequest' THEN 'rxnorm:' || p_size WHEN 'Observation' THEN 'loinc:' || p_size ELSE 'snomed:' || p_size END END AS target FROM b),
concept AS (
  SELECT *, array_to_string(list_transform(list_sort(list_distinct(['http://x|' || p_type, p_name, p_type, p_brand])), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), '|') AS ck FROM tk)
"""


@register(
    "compact_concepts",
    f"""
WITH {PART_SQL},
keyed AS (
  SELECT *, CASE
    WHEN ing AND routed THEN t || '|ingredient-route|' || pt || '+zinc|oral' WHEN ing THEN t || '|ingredient|' || pt || '+zinc'
    WHEN target IS NOT NULL AND t = 'Observation' THEN t || '|' || coalesce(lower(category), '') || '|target-code|' || target WHEN target IS NOT NULL THEN t || '|target-code|' || target
    WHEN k % 5 = 1 AND t = 'MedicationRequest' THEN t || '|code|http://x|' || p_type
    WHEN k % 5 = 1 AND t = 'Observation' THEN t || '|' || coalesce(lower(category), '') || '|concept|' || ck WHEN k % 5 = 1 THEN t || '|concept|' || ck
    WHEN t = 'Observation' THEN t || '|' || coalesce(lower(category), '') || '|label|' || lower(p_name) ELSE t || '|label|' || lower(p_name) END AS key FROM concept),
named AS (SELECT *, 'cluster:' || t || ':' || md5(key) AS compact_id FROM keyed),
cnt AS (SELECT patient_id, compact_id, p_name, count(*) AS n FROM named GROUP BY ALL),
lab AS (SELECT * FROM cnt QUALIFY row_number() OVER (PARTITION BY patient_id, compact_id ORDER BY n DESC, p_name) = 1)
SELECT n.patient_id, n.compact_id, any_value(l.p_name) AS source_label, count(*) AS resource_count, max('20' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-01-01') AS date,
  CASE WHEN bool_or(k % 41 = 0) THEN 'patient' ELSE 'provider' END AS source, bool_or(k % 29 = 0) AS inactive_overlay, CASE WHEN count(*) = 1 THEN 'active' END AS status
FROM named n JOIN lab l ON l.patient_id = n.patient_id AND l.compact_id = n.compact_id GROUP BY n.patient_id, n.compact_id
""",
)
def compact_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = grouping.compact_records(part_records(Tables(spark, sf_dir)))["concepts"]
    return concepts.select("patient_id", "compact_id", "source_label", "resource_count", "date", "source", "inactive_overlay", "status")


@register(
    "compact_values",
    f"""
WITH {PART_SQL},
keyed AS (SELECT *, CASE k % 5 WHEN 0 THEN ['snomed:' || p_size, 'loinc:' || p_size, 'rxnorm:' || p_size] WHEN 1 THEN ['http://x|' || p_type] ELSE [] END AS keys FROM b),
v AS (
  SELECT patient_id, t, 'ingredients' AS field, unnest(['zinc', p_type]) AS value FROM b WHERE ing
  UNION ALL SELECT patient_id, t, 'source_labels', p_name FROM b UNION ALL SELECT patient_id, t, 'code_texts', p_name FROM b UNION ALL SELECT patient_id, t, 'code_codings', p_type || '|' || p_brand FROM b
  UNION ALL SELECT patient_id, t, 'coding_keys', unnest(keys) FROM keyed
  UNION ALL SELECT patient_id, t, 'grouping_text', unnest(list_concat([p_name || ' ' || p_brand, p_name, category, CASE WHEN routed THEN 'Oral' END], keys, CASE WHEN ing THEN ['zinc', p_type] ELSE [] END)) FROM keyed)
SELECT t AS resource_type, field, value, count(DISTINCT patient_id) AS n_patients FROM v WHERE value IS NOT NULL GROUP BY ALL
""",
)
def compact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = grouping.compact_records(part_records(Tables(spark, sf_dir)))
    out = parts["values"].select("patient_id", F.split_part("compact_id", F.lit(":"), F.lit(2)).alias("resource_type"), "field", "value").distinct()
    return out.groupBy("resource_type", "field", "value").agg(F.count(F.lit(1)).alias("n_patients"))


@register(
    "grouping_texts",
    """
WITH v AS (SELECT p_brand, unnest([p_name, p_type, 'size ' || p_size]) AS value FROM part), d AS (SELECT DISTINCT p_brand, value FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY value) AS rn FROM d)
SELECT p_brand AS compact_id, substr(string_agg(value, ' | ' ORDER BY value), 1, 100) AS grouping_text FROM r WHERE rn <= 26 GROUP BY p_brand
""",
)
def grouping_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).part.select(F.lit("p").alias("patient_id"), F.col("p_brand").alias("compact_id"), F.lit("grouping_text").alias("field"), F.explode(F.array("p_name", "p_type", F.concat(F.lit("size "), text("p_size")))).alias("value"))
    return grouping.grouping_texts(rows.distinct(), 100).select("compact_id", "grouping_text")


@register(
    "most_common_label",
    "SELECT p_brand, p_type FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1",
)
def most_common_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.most_common_label(Tables(spark, sf_dir).part, ["p_brand"], "p_type")


GROUP_SQL = f"""
{PART_SQL},
g AS (
  SELECT *, CASE WHEN ing AND routed THEN 'medicationrequest-ingredient-route-' || {stem_sql("pt || '-zinc-oral'")} WHEN ing THEN 'medicationrequest-ingredient-' || {stem_sql("pt || '-zinc'")}
    WHEN target IS NOT NULL THEN lower(t) || '-target-code-' || replace(target, ':', '-')
    WHEN k % 5 = 1 THEN lower(t) || '-concept-' || {stem_sql('ck')}
    ELSE lower(t) || '-label-' || regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') END AS group_id,
    CASE WHEN ing AND routed THEN 0.8 WHEN ing THEN 0.7 WHEN target IS NOT NULL THEN 0.8 WHEN k % 5 = 1 THEN 0.75 ELSE 0.55 END AS conf, NOT ing AND target IS NULL AND k % 5 <> 1 AS fb,
    CASE WHEN ing THEN array_to_string(list_transform(string_split(array_to_string(list_sort([p_type, 'zinc']), ' ') || CASE WHEN routed THEN ' Oral' ELSE '' END, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE p_name END AS nm,
    CASE WHEN t = 'Observation' AND category = 'Laboratory' THEN 'labs' END AS bucket
  FROM concept)
"""


@register(
    "deterministic_groups",
    f"""
WITH {GROUP_SQL}
SELECT patient_id, group_id, arg_min(nm, k) AS name, min(conf)::DOUBLE AS confidence, bool_or(fb) AS fallback, CASE WHEN count(DISTINCT bucket) = 1 THEN max(bucket) END AS bucket, count(*) AS n_records FROM g GROUP BY ALL
""",
)
def deterministic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = grouping.deterministic_grouping(part_records(Tables(spark, sf_dir)))
    return groups.select("patient_id", "group_id", "name", "confidence", "fallback", "bucket", "n_records")


@register(
    "source_groups",
    f"WITH {PART_SQL} SELECT patient_id, lower(t) || '-source-' || id AS group_id, p_name AS name, id AS record_id, 0.5::DOUBLE AS confidence, CASE WHEN t = 'Observation' AND category = 'Laboratory' THEN 'labs' END AS bucket FROM b",
)
def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.source_groups(part_records(Tables(spark, sf_dir))).select("patient_id", "group_id", "name", "record_id", "confidence", "bucket")


def two_results(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two partial results whose groups carry the same names: by brand, and by brand and type."""
    p = t.part.select(text(F.col("p_partkey") % 10).alias("patient_id"), "p_brand", "p_type", F.col("p_partkey").alias("k"), text("p_partkey").alias("record_id"))
    a = p.select("patient_id", F.lit(0).alias("result_pos"), F.concat(F.lit("a-"), "p_brand").alias("group_id"), F.col("p_brand").alias("name"), "record_id", "k", F.lit("lookup").alias("source"), F.lit(0.9).alias("confidence"), F.lit(False).alias("fallback"), F.lit("A").alias("reason"))
    b = p.filter("k % 3 = 0").select("patient_id", F.lit(1).alias("result_pos"), F.concat_ws("-", F.lit("b"), "p_brand", "p_type").alias("group_id"), F.concat(F.lit(" "), F.lower(F.replace("p_brand", F.lit("#"), F.lit("!")))).alias("name"), "record_id", "k", F.lit("transformers").alias("source"), F.lit(0.4).alias("confidence"), (F.col("k") % 2 == 0).alias("fallback"), F.lit("B").alias("reason"))
    rows = a.unionByName(b)
    groups = rows.groupBy("patient_id", "result_pos", "group_id").agg(
        F.min("name").alias("name"), F.array(F.lit("Condition")).alias("resource_types"), F.lit(None).cast("string").alias("bucket"), F.min("confidence").alias("confidence"), F.min("reason").alias("reason"),
        F.bool_or("fallback").alias("fallback"), F.min("source").alias("source"), F.min("k").alias("group_pos"),
    )
    return groups, rows.select("patient_id", "result_pos", "group_id", "record_id")


@register(
    "combined_groups",
    """
WITH p AS (SELECT CAST(p_partkey % 10 AS VARCHAR) AS patient_id, p_brand, p_partkey AS k FROM part),
a AS (SELECT patient_id, p_brand, count(DISTINCT k) AS n_records, bool_or(k % 3 = 0) AS both_sides, bool_or(k % 6 = 0) AS fb FROM p GROUP BY ALL)
SELECT patient_id, 'a-' || p_brand AS group_id, p_brand AS name, CASE WHEN both_sides THEN 0.4 ELSE 0.9 END::DOUBLE AS confidence, fb AS fallback, n_records FROM a
""",
)
def combined_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, members = grouping.combine_groupings(*two_results(Tables(spark, sf_dir)))
    sizes = members.groupBy("patient_id", "group_id").agg(F.count(F.lit(1)).alias("n_records"))
    return groups.join(sizes, ["patient_id", "group_id"]).select("patient_id", "group_id", "name", "confidence", "fallback", "n_records")


@register(
    "combined_source",
    "SELECT CAST(p_partkey % 10 AS VARCHAR) AS patient_id, CASE WHEN bool_or(p_partkey % 3 = 0) THEN 'mixed' ELSE 'lookup' END AS source FROM part GROUP BY ALL",
)
def combined_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.result_source(two_results(Tables(spark, sf_dir))[0])


MODELS = ("patient-friendly-lookup-v2", "bm25", "my-model", "other")


def concept_cache(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    concepts = t.part.select(text(k % 20).alias("patient_id"), text(k).alias("compact_id"), k.alias("concept_pos"), pick(k % 3, "Observation", "Condition", "Procedure").alias("resource_type"), F.when(k % 6 == 0, "Laboratory").alias("category"), F.lit(None).cast("string").alias("category_code"))
    cache = t.part.filter("p_partkey % 7 <> 0").select(
        text(k).alias("compact_id"), F.when(k % 11 == 0, "Encounter").otherwise(pick(k % 3, "Observation", "Condition", "Procedure")).alias("resource_type"), F.col("p_type").alias("name"), F.when(k % 9 == 0, "vitals").alias("bucket"),
        (F.lit(0.5) + (k % 4) / 10).alias("confidence"), (k % 13 == 0).alias("fallback"), pick(k % 4, *MODELS).alias("model"), F.lit("rxnorm").alias("lookup_system"), text(k % 100).alias("lookup_code"),
        F.when(k % 2 == 0, "icd10").alias("canonical_system"), text("p_size").alias("canonical_code"), k.alias("updated_at"),
    )
    return concepts, cache


CACHE_SQL = f"""
c AS (
  SELECT p_partkey AS k, CAST(p_partkey % 20 AS VARCHAR) AS patient_id, {sql_pick('p_partkey % 3', 'Observation', 'Condition', 'Procedure')} AS t, p_partkey % 6 = 0 AS has_cat, p_type, p_size,
    p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS same, p_partkey % 4 AS m, CASE WHEN p_partkey % 9 = 0 THEN 'vitals' END AS bucket FROM part),
d AS (SELECT *, same AND CASE WHEN m < 2 THEN t <> 'Observation' OR bucket IS NOT NULL OR has_cat ELSE m = 2 END AS complete FROM c)
"""


@register("cache_split", f"WITH {CACHE_SQL} SELECT CAST(k AS VARCHAR) AS compact_id, complete AS cached FROM d")
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, cache = concept_cache(Tables(spark, sf_dir))
    return state.split_by_cache(concepts, cache, "my-model").select("compact_id", "cached")


@register("cache_coverage", f"WITH {CACHE_SQL} SELECT t AS resource_type, count(*) AS n, count(*) FILTER (complete) AS n_cached FROM d GROUP BY ALL")
def cache_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, cache = concept_cache(Tables(spark, sf_dir))
    return state.coverage(state.split_by_cache(concepts, cache, "my-model"), ["resource_type"])


@register(
    "cached_groups",
    f"""
WITH {CACHE_SQL},
e AS (SELECT *, coalesce(bucket, CASE WHEN t = 'Observation' AND has_cat THEN 'labs' END) AS b FROM d WHERE complete)
SELECT patient_id, lower(t) || '-' || lower(p_type) AS group_id, p_type AS name, min(0.5 + (k % 4) / 10)::DOUBLE AS confidence, bool_or(k % 13 = 0) AS fallback, CASE WHEN count(DISTINCT b) = 1 THEN max(b) END AS bucket,
  CASE WHEN arg_min(k % 2, k) = 0 THEN 'icd10' ELSE 'rxnorm' END AS canonical_system, CASE WHEN arg_min(k % 2, k) = 0 THEN CAST(arg_min(p_size, k) AS VARCHAR) ELSE CAST(min(k) % 100 AS VARCHAR) END AS canonical_code, count(*) AS n_concepts
FROM e GROUP BY patient_id, t, p_type
""",
)
def cached_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, cache = concept_cache(Tables(spark, sf_dir))
    groups, _ = grouping.cached_groups(concepts, cache, state.LOOKUP_MODEL, state.entry_complete("my-model"))
    return groups.select("patient_id", "group_id", "name", "confidence", "fallback", "bucket", "canonical_system", "canonical_code", "n_concepts")


@register(
    "lookup_upsert",
    f"""
WITH o AS (SELECT p_partkey AS k, {sql_pick('p_partkey % 4', *MODELS)} AS model, p_type AS name FROM part WHERE p_partkey % 7 <> 0),
n AS (SELECT p_partkey AS k, p_brand AS name FROM part WHERE p_partkey % 2 = 0)
SELECT CAST(coalesce(o.k, n.k) AS VARCHAR) AS compact_id, CASE WHEN n.k IS NOT NULL AND (o.k IS NULL OR o.model = 'patient-friendly-lookup-v2') THEN n.name ELSE o.name END AS name,
  CASE WHEN n.k IS NOT NULL AND (o.k IS NULL OR o.model = 'patient-friendly-lookup-v2') THEN 'patient-friendly-lookup-v2' ELSE o.model END AS model
FROM o FULL JOIN n ON o.k = n.k
""",
)
def lookup_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    _, cache = concept_cache(t)
    k = F.col("p_partkey")
    lookups = t.part.filter("p_partkey % 2 = 0").select(text(k).alias("compact_id"), F.lit("Condition").alias("resource_type"), F.col("p_brand").alias("name"), F.lit(state.LOOKUP_MODEL).alias("model"), (k + 1).alias("updated_at"))
    return state.upsert_lookups(cache, lookups, ["updated_at"]).select("compact_id", "name", "model")


@register(
    "expanded_members",
    """
SELECT DISTINCT CAST(l_suppkey % 10 AS VARCHAR) AS patient_id, 'g' || (l_partkey % 7) AS group_id, CASE WHEN l_partkey % 5 = 0 THEN 'c' || l_partkey ELSE 'r' || l_orderkey END AS record_id FROM lineitem
""",
)
def expanded_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Tables(spark, sf_dir).lineitem
    patient = text(F.col("l_suppkey") % 10).alias("patient_id")
    compact = F.concat(F.lit("c"), text("l_partkey"))
    held = li.select(patient, F.concat(F.lit("g"), text(F.col("l_partkey") % 7)).alias("group_id"), compact.alias("compact_id")).distinct()
    members = li.filter("l_partkey % 5 <> 0").select(patient, compact.alias("compact_id"), F.concat(F.lit("r"), text("l_orderkey")).alias("record_id"))
    return grouping.expand_members(held, members)


@register(
    "unassigned_records",
    f"WITH {PART_SQL} SELECT patient_id, count(*) AS n FROM b WHERE k % 3 <> 0 GROUP BY ALL",
)
def unassigned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_records(Tables(spark, sf_dir))
    members = rows.filter("input_pos % 3 = 0").select("patient_id", F.col("id").alias("record_id"))
    return grouping.unassigned_records(rows, members).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))


def brand_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    brand = F.get("code_codings", F.lit(0))["display"]
    shown = records.visible(rows).select("patient_id", "id", "resource_type", "input_pos", brand.alias("b"))
    members = shown.select("patient_id", F.concat(F.lit("g-"), "b").alias("group_id"), F.col("id").alias("record_id"))
    groups = shown.groupBy("patient_id", F.concat(F.lit("g-"), "b").alias("group_id")).agg(
        F.min("b").alias("name"), F.array_sort(F.collect_set("resource_type")).alias("resource_types"), F.lit(None).cast("string").alias("bucket"), F.lit(0.7).alias("confidence"), F.lit("R").alias("reason"),
        (F.min("b") < "Brand#2").alias("fallback"), F.min("input_pos").alias("group_pos"),
    )
    return groups, members


@register(
    "split_fallback_groups",
    f"""
WITH {PART_SQL}, s AS (SELECT patient_id, p_brand, count(*) AS n, p_brand < 'Brand#2' AS fb FROM b GROUP BY ALL)
SELECT b.patient_id, lower(t) || '-source-' || id AS group_id, p_name AS name, 0.5::DOUBLE AS confidence, 1::BIGINT AS n_records FROM b JOIN s ON s.patient_id = b.patient_id AND s.p_brand = b.p_brand WHERE fb AND n > 1
UNION ALL SELECT patient_id, 'g-' || p_brand, p_brand, 0.7, n FROM s WHERE NOT (fb AND n > 1)
""",
)
def split_fallback_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_records(Tables(spark, sf_dir))
    groups, members = grouping.split_fallback(*brand_groups(rows), rows)
    sizes = members.groupBy("patient_id", "group_id").agg(F.count(F.lit(1)).alias("n_records"))
    return groups.join(sizes, ["patient_id", "group_id"]).select("patient_id", "group_id", "name", "confidence", "n_records")


@register(
    "leftover_groups",
    f"""
WITH {PART_SQL}, f AS (SELECT patient_id, p_brand, count(*) AS n FROM b WHERE k % 3 <> 0 GROUP BY ALL)
SELECT patient_id, 'g-' || p_brand || CASE WHEN p_brand < 'Brand#15' THEN '-fallback-2' WHEN p_brand < 'Brand#2' THEN '-fallback-1' ELSE '' END AS group_id, p_brand AS name, 0.55::DOUBLE AS confidence, n AS n_records FROM f
""",
)
def leftover_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_records(Tables(spark, sf_dir))
    groups, members = brand_groups(rows)
    assigned = rows.filter("input_pos % 3 = 0").select("patient_id", F.col("id").alias("record_id"))
    plain = groups.select("patient_id", "group_id", "name")
    taken = plain.filter("name < 'Brand#2'").select("patient_id", "group_id").unionByName(plain.filter("name < 'Brand#15'").select("patient_id", F.concat("group_id", F.lit("-fallback-1")).alias("group_id")))
    out, kept = grouping.leftover_groups(rows, groups, members, assigned, taken)
    sizes = kept.groupBy("patient_id", "group_id").agg(F.count(F.lit(1)).alias("n_records"))
    return out.join(sizes, ["patient_id", "group_id"]).select("patient_id", "group_id", "name", "confidence", "n_records")


NAMES = ("Blood Pressure", "Systolic blood pressure", "LDL Cholesterol", "cholesterol", "Diabetes care", "Sodium", "!!", "Lab Results", "Kidney stone", "Screening visit", "Non-HDL cholesterol", "Mean arterial blood pressure")
UNSAFE = (True, False, False, True, True, False, True, True, False, True, False, False)


@register("unsafe_names", f"SELECT {sql_pick('p_partkey % 12', *NAMES)} AS name, {sql_pick('p_partkey % 12', *[str(u).lower() for u in UNSAFE])} = 'true' AS unsafe, count(*) AS n FROM part GROUP BY ALL")
def unsafe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).part.select(pick(F.col("p_partkey") % 12, *NAMES).alias("name"))
    return rows.groupBy("name", grouping.unsafe_observation_name(F.col("name")).alias("unsafe")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "rejected_groups",
    f"""
WITH {PART_SQL}, g AS (SELECT patient_id, p_brand, bool_and(t = 'Observation') AS only_obs, bool_or(k % 8 = 2) AS own FROM b GROUP BY ALL)
SELECT patient_id, 'g-' || p_brand AS group_id FROM g WHERE only_obs AND NOT own AND p_brand < 'Brand#25'
""",
)
def rejected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_records(Tables(spark, sf_dir))
    groups, members = brand_groups(rows)
    named = groups.withColumn("name", F.when(F.col("name") < "Brand#25", "Lab results").otherwise("Sodium"))
    own = rows.withColumn("source_label", F.when(F.col("input_pos") % 8 == 2, "LAB-Results").otherwise(F.col("source_label")))
    return grouping.rejected_groups(named, members, own)

