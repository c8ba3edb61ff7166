"""Checked queries over open JSON resources that are built from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import coding, dates
from ..functions.json_fields import parse_once
from ..operators import normalize, records, references, relationships
from ..session import saved, spread
from ..sources import bundles, export, scopes, terminology
from .measured import NOW_MS
from .registry import Tables, iso_seconds, pick, register, sql_pick, text

CODE_SYSTEMS = (
    "urn:oid:2.16.840.1.113883.6.1", "http://www.nlm.nih.gov/research/umls/rxnorm", "http://loinc.org", "http://snomed.info/sct", "http://hl7.org/fhir/sid/cvx",
    "OID:2.16.840.1.113883.6.96", "urn:oid:1.2.3.4", "http://hl7.org/fhir/sid/icd-10-cm", "http://local", None, "", "http://www.ama-assn.org/go/cpt",
)
KEY_PREFIXES = ("loinc:", "rxnorm:", "loinc:", "snomed:", "cvx:", "snomed:", "oid:1.2.3.4:", "icd10cm:", "http://local|", "", "", "cpt:")


def resource(df: DataFrame, rtype: str, rid: Column, pos: Column, patient: Column, source: Column, **fields: Column) -> DataFrame:
    """Rows of a table as resources of the record model, the fields as one JSON document."""
    body = F.to_json(F.struct(F.lit(rtype).alias("resourceType"), rid.alias("id"), *[c.alias(n) for n, c in fields.items()]))
    flat = spread(df).select(
        source.alias("source_id"), patient.cast("string").alias("patient_id"), pos.cast("bigint").alias("input_pos"), F.lit(rtype).alias("resource_type"), rid.alias("id"), body.alias("json")
    )
    return parse_once(flat, "json")


def part_concept(n: Column) -> Column:
    """A code with text, display or bare code only, in twelve code systems."""
    return F.struct(
        F.when(n % 3 == 0, F.concat(F.lit(" "), "p_name")).when(n % 3 == 1, "").alias("text"),
        F.array(
            F.struct(pick(n % 12, *CODE_SYSTEMS).alias("system"), text("p_partkey").alias("code"), F.when(n % 2 == 0, F.col("p_type")).alias("display")),
            F.struct(pick((n + 1) % 12, *CODE_SYSTEMS).alias("system"), F.when(n % 5 != 0, F.col("p_brand")).alias("code"), F.lit("").alias("display")),
        ).alias("coding"),
    )


PART_CONCEPT_SQL = f"""
c AS (
  SELECT *, p_partkey AS n, CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_name WHEN p_partkey % 2 = 0 THEN p_type ELSE CAST(p_partkey AS VARCHAR) END AS label,
    {sql_pick('p_partkey % 12', *KEY_PREFIXES)} || CAST(p_partkey AS VARCHAR) AS key1,
    CASE WHEN p_partkey % 5 <> 0 THEN {sql_pick('(p_partkey + 1) % 12', *KEY_PREFIXES)} || p_brand END AS key2
  FROM part)
"""


@register(
    "concept_texts_and_keys",
    f"""
WITH {PART_CONCEPT_SQL}
SELECT p_partkey, label, concat_ws(' ; ', key1, key2) AS coding_keys, concat_ws(' ; ', CAST(p_partkey AS VARCHAR), CASE WHEN n % 5 <> 0 THEN p_brand END) AS codes,
  CASE WHEN n % 3 = 0 THEN p_name END AS summary_text, CASE WHEN n % 5 <> 0 THEN 2 ELSE 1 END AS n_codings FROM c
""",
)
def concept_texts_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    rows = Tables(spark, sf_dir).part.select("p_partkey", F.try_variant_get(F.parse_json(F.to_json(part_concept(n))), "$", coding.CONCEPT_TYPE).alias("c"))
    c = F.col("c")
    return rows.select(
        "p_partkey", coding.concept_text(c).alias("label"), F.array_join(coding.coding_keys(c), " ; ").alias("coding_keys"), F.array_join(coding.concept_codes(c), " ; ").alias("codes"),
        coding.code_summary(c)["text"].alias("summary_text"), F.size(coding.code_summary(c)["codings"]).alias("n_codings"),
    )


@register(
    "bundle_scan",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Encounter' ELSE 'Procedure' END AS resource_type, 'r' || o_orderkey AS id, 1 AS entry_pos FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, 'Patient', 'c' || o_custkey, 2 FROM orders WHERE o_orderstatus <> 'P'
""",
)
def bundle_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rtype = F.when(F.col("o_orderkey") % 2 == 0, "Encounter").otherwise("Procedure")
    entry = lambda r, i: F.struct(F.struct(r.alias("resourceType"), i.alias("id")).alias("resource"), F.lit("x").alias("fullUrl"))
    empty = F.struct(F.lit(None).cast("struct<resourceType:string,id:string>").alias("resource"), F.lit("none").alias("fullUrl"))
    bundle = F.struct(
        F.when(F.col("o_orderstatus") != "P", "Bundle").otherwise("List").alias("resourceType"),
        F.array(empty, entry(rtype, F.concat(F.lit("r"), text("o_orderkey"))), entry(F.lit("Patient"), F.concat(F.lit("c"), text("o_custkey")))).alias("entry"),
    )
    rows = parse_once(Tables(spark, sf_dir).heavy("orders").select("o_orderkey", F.to_json(bundle).alias("json")), "json")
    return bundles.bundle_entries(rows).select("o_orderkey", "resource_type", "id", "entry_pos")


SCOPES = ("patient/Observation.read patient/Condition.read", "user/*.read", "  ", "patient/*.read openid", "openid  user/Encounter.read")
TYPES = ("Observation", "Condition", "Encounter", "Patient", "Immunization")


@register(
    "scope_filtered_types",
    f"""
WITH x AS (SELECT c_custkey, {sql_pick('c_custkey % 5', *SCOPES)} AS scope, {sql_pick('(c_custkey // 5) % 5', *TYPES)} AS t FROM customer),
y AS (SELECT *, regexp_split_to_array(trim(scope), '\\s+') AS s FROM x)
SELECT c_custkey, t AS resource_type, t = 'Patient' OR trim(scope) = '' OR list_has_any(s, ['patient/' || t || '.read', 'user/' || t || '.read', 'patient/*.read', 'user/*.read', '*/*.read']) AS allowed FROM y
""",
)
def scope_filtered_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).customer.select("c_custkey", pick(F.col("c_custkey") % 5, *SCOPES).alias("scope"), pick(F.floor(F.col("c_custkey") / 5) % 5, *TYPES).alias("resource_type"))
    return rows.select("c_custkey", "resource_type", scopes.scope_allows(F.col("scope"), F.col("resource_type")).alias("allowed"))


FNV_SQL = "lower(to_base(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split({0}, ''), lambda ch: ord(ch)::UBIGINT)), lambda h, ch: (xor(h, ch) * 16777619) % 4294967296)::BIGINT, 36))"


@register(
    "source_ids",
    f"SELECT c_custkey, 'src-' || {FNV_SQL.format(chr(39) + 'https://fhir' + chr(39) + ' || c_nationkey || ' + chr(39) + '.example.org/r4|' + chr(39) + ' || CASE WHEN c_custkey % 10 = 0 THEN ' + chr(39) + 'unknown-patient' + chr(39) + ' ELSE CAST(c_custkey AS VARCHAR) END')} AS source_id FROM customer",
)
def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://fhir"), text("c_nationkey"), F.lit(".example.org/r4/"))
    return Tables(spark, sf_dir).customer.select("c_custkey", bundles.source_id_for(url, F.when(F.col("c_custkey") % 10 != 0, text("c_custkey"))).alias("source_id"))


@register(
    "multi_source_merge",
    """
SELECT 's' || (o_custkey % 3) || ':' || o_orderkey AS id, 's' || (o_custkey % 3) AS portal_source_id, 'Portal ' || (o_custkey % 3) AS portal_source_name, CASE WHEN o_custkey % 3 = 2 THEN o_orderpriority END AS extra FROM orders
""",
)
def multi_source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tables(spark, sf_dir).orders.select(text("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("_s"), F.col("o_orderpriority").alias("extra"))
    parts = [
        bundles.scope_to_source(orders.filter(F.col("_s") == n).drop(*(["extra"] if n != 2 else [])), F.lit(f"s{n}"), F.lit(f"Portal {n}")).drop("_s") for n in range(3)
    ]
    return bundles.merge_sources(*parts).select("id", "portal_source_id", "portal_source_name", "extra")


@register(
    "source_status",
    """
SELECT c_nationkey, count(*) AS n_sources, CAST(sum(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 50 ELSE 7 END) AS BIGINT) AS n_resources,
  count(*) FILTER (c_custkey % 5 IN (1, 3)) AS n_reconnect, CAST(sum(c_custkey % 4 + CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS n_unresolved FROM customer GROUP BY ALL
""",
)
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = Tables(spark, sf_dir).customer.select(
        "c_nationkey", pick(k % 5, "connected", "error", "ready", "needs-reconnect", "fetching").alias("status"), F.when(k % 2 == 0, k % 50).alias("resource_count"), F.lit(7).alias("record_count"),
        (k % 4).alias("unresolved"), F.when(k % 3 == 0, 2).alias("skipped"),
    )
    return bundles.source_status(rows, ["c_nationkey"])


@register(
    "lookback_filter",
    """
WITH o AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 4 WHEN 0 THEN 'Observation' WHEN 1 THEN 'Condition' WHEN 2 THEN 'Encounter' ELSE 'Immunization' END AS t, CASE WHEN o_orderkey % 11 = 0 THEN 'unreadable' WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'ok' END AS d FROM orders)
SELECT t AS resource_type, count(*) AS n, min(o_orderkey) AS first_key FROM o WHERE t = 'Condition' OR d IS NULL OR d = 'unreadable' OR o_orderdate >= make_timestamp_ms(901929600000 - 365::BIGINT * 86400000) GROUP BY ALL
""",
)
def lookback_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.when(k % 11 == 0, "unreadable").when(k % 13 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    rtype = pick(k % 4, "Observation", "Condition", "Encounter", "Immunization")
    body = F.to_json(F.struct(F.when(k % 4 == 0, day).alias("effectiveDateTime"), F.when(k % 4 == 1, day).alias("recordedDate"), F.when(k % 4 == 2, F.struct(F.when(k % 8 != 2, day).alias("start"), day.alias("end"))).alias("period"), F.when(k % 4 == 3, day).alias("occurrenceDateTime")))
    rows = parse_once(Tables(spark, sf_dir).heavy("orders").select("o_orderkey", rtype.alias("resource_type"), body.alias("json")), "json")
    return export.filter_lookback(rows, 365, 901_929_600_000).groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@register(
    "collection_export",
    """
SELECT CAST(o_custkey AS VARCHAR) AS patient_id, 'Encounter/' || o_orderkey AS full_url, o_orderpriority AS inner_value FROM orders
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'PatientPatch/p' || o_orderkey, 'hidden' FROM orders WHERE o_orderkey % 3 = 0
""",
)
def collection_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tables(spark, sf_dir).orders
    key = text("o_orderkey")
    shown = resource(orders, "Encounter", key, F.col("o_orderkey"), F.col("o_custkey"), F.lit("s"), value=F.col("o_orderpriority"))
    patches = orders.filter("o_orderkey % 3 = 0 or o_orderkey % 7 = 0").select(
        text("o_custkey").alias("patient_id"), F.lit("Encounter").alias("target_type"), F.when(F.col("o_orderkey") % 3 == 0, key).otherwise(F.concat(F.lit("gone-"), key)).alias("target_id"),
        F.concat(F.lit("p"), key).alias("patch_id"), F.lit("patientRecordVisibility").alias("field"), F.lit("hidden").alias("value"), iso_seconds("o_orderdate").alias("authored_at"),
    )
    return export.collection_entries(shown, patches).select("patient_id", "full_url", F.get_json_object("resource", "$.value").alias("inner_value"))


@register(
    "payload_gate",
    "SELECT doc_id, octet_length(encode(to_json({'text': text, 'lang': lang})::VARCHAR)) AS n_bytes, octet_length(encode(to_json({'text': text, 'lang': lang})::VARCHAR)) <= 1800 AS fits FROM documents",
)
def payload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.struct("text", "lang")
    return Tables(spark, sf_dir).documents.select("doc_id", export.payload_bytes(value).cast("bigint").alias("n_bytes"), export.payload_fits(value).alias("fits"))


@register(
    "terminology_shard_scan",
    """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'loinc' ELSE 'rxnorm' END AS system, CAST(p_partkey AS VARCHAR) AS code, p_name AS name, 'CHV' AS friendly_source, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'exact' END AS match_type, 'icd10' AS canonical_system FROM part
WHERE p_size % 2 = 0 AND p_partkey % 9 <> 0
""",
)
def terminology_shard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Tables(spark, sf_dir).part
    entry = F.struct(F.when(F.col("p_partkey") % 9 != 0, F.col("p_name")).alias("name"), F.lit("CHV").alias("friendly_source"), F.when(F.col("p_size") % 3 != 0, "exact").alias("match_type"), F.lit("ICD10CM").alias("canonical_system"))
    shards = part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, "loinc").otherwise("rxnorm").alias("system"), F.to_json(F.create_map(text("p_partkey"), entry)).alias("value"))
    terms = terminology.shard_entries(shards, F.col("system"))
    keys = part.filter("p_size % 2 = 0").select(F.concat(F.lit("LNC:"), text("p_partkey")).alias("coding_key"))
    return terminology.restrict_to_systems(terms, keys).select("p_partkey", "system", "code", "name", "friendly_source", "match_type", "canonical_system")


@register("csv_lines", "SELECT p_partkey, p_name || ', \"' || p_type || '\"' AS name, p_brand AS code FROM part")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit('"'), "p_name", F.lit(', ""'), "p_type", F.lit('"""'))
    line = F.concat_ws(",", F.lit("condition"), quoted, F.lit("ICD10CM"), "p_brand")
    rows = Tables(spark, sf_dir).part.select("p_partkey", terminology.csv_line_fields(line, "category string, name string, source string, code string").alias("_c"))
    return rows.select("p_partkey", "_c.name", "_c.code")


@register("shard_manifest", "SELECT p_brand AS system, count(*) AS entries FROM part GROUP BY ALL")
def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terminology.shard_manifest(Tables(spark, sf_dir).part.select(F.col("p_brand").alias("system")))


@register(
    "patient_ages",
    """
WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, make_date(2000 + o_orderkey % 30, 1 + o_orderkey % 12, 1 + o_orderkey % 28) AS t FROM orders),
a AS (SELECT o_orderkey, year(t) - year(d) - CASE WHEN month(t) * 100 + day(t) < month(d) * 100 + day(d) THEN 1 ELSE 0 END AS age FROM o)
SELECT o_orderkey, CAST(CASE WHEN age BETWEEN 0 AND 129 THEN age END AS INTEGER) AS age FROM a
""",
)
def patient_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    today = F.make_date((k % 30 + 2000).cast("int"), (k % 12 + 1).cast("int"), (k % 28 + 1).cast("int"))
    return Tables(spark, sf_dir).orders.select("o_orderkey", dates.age_in_years(F.date_format("o_orderdate", "yyyy-MM-dd"), today).cast("int").alias("age"))


@register(
    "patient_names",
    """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Official ' || c_custkey WHEN c_custkey % 4 = 1 THEN 'Ann B ' || c_mktsegment WHEN c_custkey % 4 = 2 THEN c_name END AS name FROM customer
""",
)
def patient_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = "array<struct<use:string,text:string,given:array<string>,family:string>>"
    null = F.lit(None).cast("string")
    name = lambda use, words, given, family: F.struct(use.alias("use"), words.alias("text"), given.alias("given"), family.alias("family"))
    no_given = F.lit(None).cast("array<string>")
    first = name(F.lit("usual"), F.when(k % 4 == 2, F.col("c_name")).when(k % 4 == 1, "  "), F.when(k % 4 == 1, F.array(F.lit("Ann"), F.lit(" B"))), F.when(k % 4 == 1, F.col("c_mktsegment")))
    second = name(F.lit("official"), F.concat(F.lit(" Official "), text("c_custkey")), no_given, null)
    names = F.when(k % 4 == 0, F.array(first, second)).when(k % 4 == 3, F.array().cast(kind)).otherwise(F.array(first)).cast(kind)
    rows = parse_once(Tables(spark, sf_dir).customer.select("c_custkey", F.to_json(F.struct(names.alias("name"))).alias("json")), "json")
    return rows.select("c_custkey", normalize.patient_name(F.col("body")).alias("name"))


# --- resources for links: events are observations, orders visits, customers conditions, parts reports


def linked_resources(t: Tables, n_orders: Column) -> DataFrame:
    e, o, c, p = t.events, t.orders, t.customer, t.part
    src = F.lit("s1")
    ref = lambda x: F.struct(x.alias("reference"))
    k = F.col("event_id")
    visit = F.concat(pick(k % 4, "Encounter/", "https://h.example/r4/Encounter/", "/Encounter/", "Encounter/"), text(k % n_orders), pick(k % 4, "", "/_history/2", "?x=1", ""))
    obs = resource(e, "Observation", text("event_id"), k, F.col("user_id"), src, encounter=F.when(k % 9 != 0, ref(visit)), derivedFrom=F.when(k % 6 == 0, F.array(ref(F.concat(F.lit("Observation/"), text(k + 1))))),
                  basedOn=F.array(ref(F.concat(F.lit("ServiceRequest/"), text(k)))),
    )
    ok = F.col("o_orderkey")
    enc = resource(o, "Encounter", text("o_orderkey"), ok, F.col("o_custkey"), src, reasonReference=F.when(ok % 3 == 0, F.array(ref(F.concat(F.lit("Condition/"), text("o_custkey"))))),
                  diagnosis=F.when(ok % 5 == 0, F.array(F.struct(ref(F.concat(F.lit("Condition/"), text(F.col("o_custkey") + 1))).alias("condition")))), partOf=F.when(ok % 7 == 0, ref(F.concat(F.lit("Encounter/"), text("o_orderkey")))),
    )
    con = resource(c, "Condition", text("c_custkey"), F.col("c_custkey"), F.col("c_custkey"), src)
    pk = F.col("p_partkey")
    rep = resource(p, "DiagnosticReport", text("p_partkey"), pk, pk, src, result=F.array(ref(F.concat(F.lit("Observation/"), text(pk * 3))), ref(F.concat(F.lit("#local"), text(pk)))),
                  encounter=F.when(pk % 2 == 0, ref(F.concat(F.lit("Encounter/"), text(pk * 2)))),
    )
    return reduce(DataFrame.unionByName, [obs, enc, con, rep])


def _n_orders(t: Tables) -> Column:
    return t.orders.agg(F.count(F.lit(1)).cast("bigint")).scalar()


EDGES_SQL = """
no AS (SELECT count(*) AS n FROM orders),
edges AS (
  SELECT 'Observation/s1:' || event_id AS src, 'Encounter/s1:' || (event_id % n) AS dst, 'encounter' AS kind, 'Observed during visit' AS label FROM events, no WHERE event_id % 9 <> 0 AND (event_id % n) IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'Observation/s1:' || event_id, 'Observation/s1:' || (event_id + 1), 'derived_from', 'Derived from' FROM events WHERE event_id % 6 = 0 AND event_id + 1 IN (SELECT event_id FROM events)
  UNION ALL SELECT 'Encounter/s1:' || o_orderkey, 'Condition/s1:' || o_custkey, 'reason', 'Visit reason' FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'Encounter/s1:' || o_orderkey, 'Condition/s1:' || (o_custkey + 1), 'diagnosis', 'Visit diagnosis' FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey + 1 IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'DiagnosticReport/s1:' || p_partkey, 'Observation/s1:' || (p_partkey * 3), 'result', 'Report result' FROM part WHERE p_partkey * 3 IN (SELECT event_id FROM events)
  UNION ALL SELECT 'DiagnosticReport/s1:' || p_partkey, 'Encounter/s1:' || (p_partkey * 2), 'encounter', 'Reported during visit' FROM part WHERE p_partkey % 2 = 0 AND p_partkey * 2 IN (SELECT o_orderkey FROM orders))
"""


def linked_edges(t: Tables) -> DataFrame:
    return relationships.explicit_edges(linked_resources(t, _n_orders(t)))


@register("explicit_edges", f"WITH {EDGES_SQL} SELECT src, dst, kind, label, {FNV_SQL.format('concat_ws(' + chr(39) + '|' + chr(39) + ', src, dst, kind)')} AS edge_id FROM edges")
def explicit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_edges(Tables(spark, sf_dir)).select("src", "dst", "kind", "label", "edge_id")


@register(
    "edge_adjacency",
    f"WITH {EDGES_SQL}, a AS (SELECT src AS record_key, kind FROM edges UNION ALL SELECT dst, kind FROM edges) SELECT record_key, count(*) AS degree, count(DISTINCT kind) AS n_kinds FROM a GROUP BY ALL",
)
def edge_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = relationships.adjacency(linked_edges(Tables(spark, sf_dir)))
    return adj.groupBy("record_key").agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("kind").alias("n_kinds"))


@register(
    "observation_conditions",
    f"""
WITH {EDGES_SQL},
ec AS (SELECT src AS enc, dst AS con FROM edges WHERE kind IN ('reason', 'diagnosis')),
oe AS (SELECT src AS obs, dst AS enc FROM edges WHERE kind = 'encounter' AND src LIKE 'Observation/%'),
re AS (SELECT src AS rep, dst AS enc FROM edges WHERE kind = 'encounter' AND src LIKE 'DiagnosticReport/%'),
ro AS (SELECT src AS rep, dst AS obs FROM edges WHERE kind = 'result')
SELECT obs AS observation_key, con AS condition_key FROM oe JOIN ec USING (enc)
UNION SELECT obs, con FROM ro JOIN re USING (rep) JOIN ec USING (enc)
""",
)
def observation_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships.observation_conditions(saved(linked_edges(Tables(spark, sf_dir))))


# Groups for link views: observations by type and user bucket, visits by status, conditions by segment.
MEMBERS_SQL = """
members AS (
  SELECT 'g' || event_type AS group_id, 'Type ' || event_type AS name, 'Observation/s1:' || event_id AS record_key, 1 AS group_pos FROM events
  UNION ALL SELECT 'gsecond', 'Second', 'Observation/s1:' || event_id, 2 FROM events WHERE event_id % 4 = 0
  UNION ALL SELECT 'g' || o_orderstatus, 'Visit ' || o_orderstatus, 'Encounter/s1:' || o_orderkey, 3 FROM orders
  UNION ALL SELECT 'g' || c_mktsegment, 'Condition ' || c_mktsegment, 'Condition/s1:' || c_custkey, 4 FROM customer),
adj AS (SELECT src AS record_key, dst AS related_key, kind, label FROM edges UNION ALL SELECT dst, src, kind, label FROM edges)
"""


def link_members(t: Tables) -> DataFrame:
    def rows(df: DataFrame, gid: Column, name: Column, key: Column, pos: int) -> DataFrame:
        return df.select(F.lit("all").alias("patient_id"), gid.alias("group_id"), name.alias("name"), key.alias("record_key"), F.lit(pos).alias("group_pos"))

    obs = F.concat(F.lit("Observation/s1:"), text("event_id"))
    return reduce(
        DataFrame.unionByName,
        [
            rows(t.events, F.concat(F.lit("g"), "event_type"), F.concat(F.lit("Type "), "event_type"), obs, 1),
            rows(t.events.filter("event_id % 4 = 0"), F.lit("gsecond"), F.lit("Second"), obs, 2),
            rows(t.orders, F.concat(F.lit("g"), "o_orderstatus"), F.concat(F.lit("Visit "), "o_orderstatus"), F.concat(F.lit("Encounter/s1:"), text("o_orderkey")), 3),
            rows(t.customer, F.concat(F.lit("g"), "c_mktsegment"), F.concat(F.lit("Condition "), "c_mktsegment"), F.concat(F.lit("Condition/s1:"), text("c_custkey")), 4),
        ],
    )


@register(
    "record_group_index",
    f"WITH {EDGES_SQL}, {MEMBERS_SQL} SELECT record_key, group_id, name FROM members QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY group_pos) = 1",
)
def record_group_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships.record_groups(link_members(Tables(spark, sf_dir))).select("record_key", "group_id", "name")


@register(
    "explicit_group_links",
    f"""
WITH {EDGES_SQL}, {MEMBERS_SQL},
firsts AS (SELECT record_key, group_id, name FROM members QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY group_pos) = 1),
l AS (SELECT DISTINCT m.group_id, a.related_key, a.kind FROM members m JOIN adj a ON a.record_key = m.record_key WHERE NOT EXISTS (SELECT 1 FROM members o WHERE o.group_id = m.group_id AND o.record_key = a.related_key))
SELECT l.group_id, l.kind, f.name AS related_group_name, count(*) AS n FROM l LEFT JOIN firsts f ON f.record_key = l.related_key GROUP BY ALL
""",
)
def explicit_group_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    members, adj = link_members(t), relationships.adjacency(linked_edges(t))
    links = relationships.explicit_group_links(members, adj, relationships.record_groups(members))
    return links.groupBy("group_id", "kind", "related_group_name").agg(F.count(F.lit(1)).alias("n"))


@register(
    "explicit_context",
    f"""
WITH {EDGES_SQL}, {MEMBERS_SQL},
x AS (SELECT DISTINCT m.group_id, a.label || ': ' || a.related_key AS context FROM members m JOIN adj a ON a.record_key = m.record_key)
SELECT group_id, context, CAST(row_number() OVER (PARTITION BY group_id ORDER BY context) AS INTEGER) AS context_pos FROM x
""",
)
def explicit_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    adj = relationships.adjacency(saved(linked_edges(t)))
    labels = adj.select("related_key").distinct().select(F.col("related_key").alias("record_key"), F.col("related_key").alias("name"))
    return relationships.explicit_context(link_members(t), adj, labels).select("group_id", "context", "context_pos")


@register(
    "reference_resolution",
    """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS k, CASE WHEN l_suppkey % 10 = 0 THEN -1 ELSE l_orderkey END AS target FROM lineitem)
SELECT k, coalesce(o.o_orderstatus, 'unresolved') AS found, count(*) AS n FROM l LEFT JOIN orders o ON o.o_orderkey = l.target AND l.k <> 3 GROUP BY ALL
""",
)
def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    k = F.col("l_partkey") % 4
    target = F.when(F.col("l_suppkey") % 10 == 0, F.lit(-1)).otherwise(F.col("l_orderkey"))
    reference = F.concat(pick(k, "Encounter/", "https://H.example/r4/Encounter/", "/Encounter/", "https://other.example/r4/Encounter/"), text(target))
    refs = t.lineitem.select(F.lit("s").alias("source_id"), k.alias("k"), reference.alias("reference"))
    index = t.orders.select(F.lit("s").alias("source_id"), F.concat(F.lit("Encounter/"), text("o_orderkey")).alias("key"), "o_orderstatus")
    out = references.resolve_references(refs, index, F.lit("https://h.example/r4/"))
    return out.groupBy("k", F.coalesce("o_orderstatus", F.lit("unresolved")).alias("found")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "missing_references",
    """
WITH r AS (
  SELECT user_id % 7 AS s, event_id, 0 AS rule, 'Encounter' AS t, CAST(event_id % 3000 AS VARCHAR) AS i FROM events
  UNION ALL SELECT user_id % 7, event_id + 1000000000, 1, 'Condition', CAST(event_id % 500 + 1400 AS VARCHAR) FROM events WHERE event_id % 5 = 0),
d AS (SELECT s, t, i, min(event_id) AS seen FROM r WHERE NOT (t = 'Encounter' AND CAST(i AS BIGINT) % 10 <> 0) GROUP BY ALL),
k AS (SELECT *, s <> 3 OR t = 'Condition' AS readable FROM d)
SELECT 's' || s AS source_id, t AS target_type, i AS target_id, 'https://h.example/' || t || '/' || i AS url, NOT readable AS skipped FROM k
""",
)
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    ref = lambda x: F.struct(x.alias("reference"))
    k, src = F.col("event_id"), F.concat(F.lit("s"), text(F.col("user_id") % 7))
    obs = resource(t.events, "Observation", text(k), k, F.col("user_id"), src, encounter=ref(F.concat(F.lit("Encounter/"), text(k % 3000))))
    proc = resource(t.events.filter("event_id % 5 = 0"), "Procedure", text(k), k + 1_000_000_000, F.col("user_id"), src, reasonReference=F.array(ref(F.concat(F.lit("https://h.example/Condition/"), text(k % 500 + 1400)))))
    refs = references.display_references(obs.unionByName(proc))
    seven = F.explode(F.array(*[F.lit(f"s{n}") for n in range(7)]))
    present = t.events.select((k % 3000).alias("i")).filter("i % 10 <> 0").distinct().select(seven.alias("source_id"), F.lit("Encounter").alias("resource_type"), text("i").alias("id"))
    scope = F.when(F.col("source_id") == "s3", "patient/Condition.read").otherwise("user/*.read")
    out = references.missing_references(refs, present, F.lit("https://h.example"), scope)
    return out.select("source_id", "target_type", "target_id", "url", "skipped")
