"""Checked queries for the eight typed tables and the unified record table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import normalize, records
from .registry import Tables, iso_seconds, pick, register, sql_pick, text
from .resources import resource

ROUTE_WORDS = ("Oral Tablet", "eye drops", "inhaled puff", "IV bag", "skin Patch", "by mouth", "plain", "topical gel", "sc pen", "rectal", "nasal spray", "im shot")
ROUTE_NAMES = ("Oral", "Ophthalmic", "Inhaled", "Intravenous", "Transdermal", "Oral", None, "Topical", "Subcutaneous", "Rectal", "Nasal", "Intramuscular")


def _concept(words: Column, system: str, code: Column) -> Column:
    return F.struct(words.alias("text"), F.array(F.struct(F.lit(system).alias("system"), code.alias("code"), F.lit("shown").alias("display"))).alias("coding"))


def medication_resources(t: Tables) -> DataFrame:
    """Line items as requests; two of three refer to a part (a medication), the rest carry a concept."""
    src = F.lit("s1")
    k = F.col("l_partkey")
    ref = F.struct(F.concat(F.lit("Medication/"), text(k + F.when(k % 10 == 0, 10_000_000).otherwise(0))).alias("reference"), F.when(k % 20 == 0, "Shown name").alias("display"))
    rid = F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"))
    own = k % 3 == 0
    dosing = F.array(F.struct(F.lit(" ").alias("text"), F.lit(None).cast("struct<text:string>").alias("route")), F.struct(F.when(k % 7 == 0, "take by mouth").alias("text"), F.when(k % 11 == 0, F.struct(F.lit("Given route").alias("text"))).alias("route")))
    requests = resource(
        t.lineitem, "MedicationRequest", rid, F.col("l_orderkey"), F.col("l_suppkey"), src, status=F.when(F.col("l_linestatus") == "F", "completed"), authoredOn=F.date_format("l_shipdate", "yyyy-MM-dd"),
        medicationCodeableConcept=F.when(own, _concept(F.concat(F.lit("Drug "), text(k)), "http://www.nlm.nih.gov/research/umls/rxnorm", text(k))), medicationReference=F.when(~own, ref), dosageInstruction=dosing,
    )
    p = F.col("p_partkey")
    product = F.struct(F.concat(F.lit("Product "), "p_name").alias("text"), F.array(F.struct(F.lit("http://hl7.org/fhir/sid/ndc").alias("system"), text(p).alias("code"))).alias("coding"))
    none = F.lit(None)
    ingredient = F.array(
        F.struct(F.struct(F.col("p_type").alias("text")).alias("itemCodeableConcept"), none.cast("struct<display:string>").alias("itemReference")),
        F.struct(none.cast("struct<text:string>").alias("itemCodeableConcept"), F.struct(F.col("p_brand").alias("display")).alias("itemReference")),
    )
    products = resource(t.part, "Medication", text(p), p, p, src, code=product, form=F.struct(pick(p % 12, *ROUTE_WORDS).alias("text")), ingredient=ingredient)
    return requests.unionByName(products)


MEDICATION_SQL = f"""
l AS (
  SELECT *, l_partkey AS k, l_partkey % 3 = 0 AS own, l_partkey % 3 <> 0 AND l_partkey % 10 <> 0 AS hit FROM lineitem),
j AS (SELECT l.*, p.p_name, p.p_type, p.p_brand, {sql_pick('k % 12', *ROUTE_WORDS)} AS form, {sql_pick('k % 12', *ROUTE_NAMES)} AS form_route FROM l LEFT JOIN part p ON l.hit AND p.p_partkey = l.k)
"""
MEDICATION_LABEL = "CASE WHEN own THEN 'Drug ' || k WHEN p_name IS NOT NULL THEN 'Product ' || p_name WHEN k % 20 = 0 THEN 'Shown name' ELSE 'Medication/' || (k + CASE WHEN k % 10 = 0 THEN 10000000 ELSE 0 END) END"


@register(
    "medication_table",
    f"""
WITH {MEDICATION_SQL}
SELECT k % 60 AS k, {MEDICATION_LABEL} AS label,
  CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'unknown' END AS status, CASE WHEN own THEN 'rxnorm:' || k WHEN p_name IS NOT NULL THEN 'ndc:' || k ELSE '' END AS coding_keys,
  CASE WHEN p_name IS NOT NULL THEN p_type || ',' || p_brand ELSE '' END AS ingredients,
  CASE WHEN k % 11 = 0 THEN 'Given route' ELSE coalesce(CASE WHEN p_name IS NOT NULL THEN form_route END, CASE WHEN k % 7 = 0 THEN 'Oral' END) END AS route, count(*) AS n
FROM j GROUP BY ALL
""",
)
def medication_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    meds = normalize.medications(medication_resources(Tables(spark, sf_dir)))
    k = F.split_part("id", F.lit("-"), F.lit(3)).cast("bigint") % 60
    out = meds.select(k.alias("k"), "label", "status", F.array_join("coding_keys", ",").alias("coding_keys"), F.array_join("ingredients", ",").alias("ingredients"), "route")
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


@register(
    "inferred_routes",
    f"SELECT p_partkey, {sql_pick('p_partkey % 12', *ROUTE_NAMES)} AS route FROM part",
)
def inferred_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = pick(F.col("p_partkey") % 12, *ROUTE_WORDS)
    rows = Tables(spark, sf_dir).part.select("p_partkey", normalize.route_words(F.col("p_brand"), words, F.lit(None).cast("string")).alias("words"))
    return rows.select("p_partkey", normalize.infer_route(F.col("words")).alias("route"))


def customer_code(k: Column) -> Column:
    return F.struct(
        F.when(k % 3 == 0, F.concat(F.lit("Seg "), "c_mktsegment")).alias("text"),
        F.array(F.struct(F.lit("http://snomed.info/sct").alias("system"), text(k % 50).alias("code"), F.when(k % 3 == 1, "Displayed").alias("display"))).alias("coding"),
    )


CUSTOMER_LABEL = "CASE c_custkey % 3 WHEN 0 THEN 'Seg ' || c_mktsegment WHEN 1 THEN 'Displayed' ELSE CAST(c_custkey % 50 AS VARCHAR) END"
STATUS_WORDS = ("active", "resolved", None, "inactive")


def allergy_resources(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    status = F.when(k % 4 != 2, F.struct(F.array(F.struct(pick(k % 4, *STATUS_WORDS).alias("code"))).alias("coding")))
    return resource(t.customer, "AllergyIntolerance", text(k), k, k, F.lit("s1"), code=customer_code(k), clinicalStatus=status, criticality=F.when(k % 5 == 0, "high"), recordedDate=F.when(k % 2 == 0, "2024-01-02"))


@register(
    "allergy_table",
    f"SELECT CAST(c_custkey AS VARCHAR) AS id, {CUSTOMER_LABEL} AS label, {sql_pick('c_custkey % 4', *STATUS_WORDS)} AS status, CASE WHEN c_custkey % 5 = 0 THEN 'high' END AS criticality, 'snomed:' || (c_custkey % 50) AS coding_keys, CASE WHEN c_custkey % 2 = 0 THEN '2024-01-02' END AS authored_at FROM customer",
)
def allergy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.allergies(allergy_resources(Tables(spark, sf_dir))).select("id", "label", "status", "criticality", F.array_join("coding_keys", ",").alias("coding_keys"), "authored_at")


def condition_resources(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return resource(t.customer, "Condition", text(k), k, k, F.lit("s1"), code=customer_code(k), clinicalStatus=F.struct(pick(k % 4, *STATUS_WORDS).alias("text")), recordedDate=F.when(k % 3 == 0, "2024-03-01"), onsetDateTime=F.when(k % 2 == 0, "2023-05-01T10:00:00Z"))


@register(
    "condition_table",
    f"SELECT CAST(c_custkey AS VARCHAR) AS id, {CUSTOMER_LABEL} AS label, {sql_pick('c_custkey % 4', *STATUS_WORDS)} AS status, CASE WHEN c_custkey % 3 = 0 THEN '2024-03-01' WHEN c_custkey % 2 = 0 THEN '2023-05-01T10:00:00Z' END AS authored_at FROM customer",
)
def condition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.conditions(condition_resources(Tables(spark, sf_dir))).select("id", "label", "status", "authored_at")


def observation_resources(t: Tables) -> DataFrame:
    k = F.col("event_id")
    cat = F.struct(F.when(k % 2 == 0, "Laboratory").alias("text"), F.array(F.struct(F.lit("laboratory").alias("code"))).alias("coding"))
    code = F.struct(F.array(F.struct(F.lit("http://loinc.org").alias("system"), F.concat(F.lit("L-"), "event_type").alias("code"), F.col("event_type").alias("display"))).alias("coding"))
    quantity = F.struct(F.col("value").alias("value"), F.lit("mg/dL").alias("unit"))
    return resource(
        t.events, "Observation", text(k), k, F.col("user_id"), F.lit("s1"), status=F.when(k % 6 != 0, "final"), code=code, category=F.when(k % 3 != 0, F.array(cat)), valueQuantity=quantity,
        effectiveDateTime=F.when(k % 4 == 0, iso_seconds("ts")), issued=F.when(k % 4 == 1, iso_seconds("ts")), effectivePeriod=F.when(k % 4 == 2, F.struct(iso_seconds("ts").alias("end"))),
    )


@register(
    "observation_table",
    """
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS label, CASE WHEN event_id % 6 <> 0 THEN 'final' ELSE 'unknown' END AS status,
  CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 'Laboratory' ELSE 'laboratory' END END AS category, CASE WHEN event_id % 3 <> 0 THEN 'laboratory' END AS category_code,
  'loinc:L-' || event_type AS coding_keys, CASE WHEN event_id % 4 < 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS effective_date, value AS numeric_value, 'mg/dL' AS unit FROM events
""",
)
def observation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize.observations(observation_resources(Tables(spark, sf_dir)))
    return out.select("id", "label", "status", "category", "category_code", F.array_join("coding_keys", ",").alias("coding_keys"), "effective_date", F.col("value.numeric_value").alias("numeric_value"), F.col("value.display_unit").alias("unit"))


def immunization_resources(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    code = F.struct(F.when(k % 2 == 0, "Vaccine").alias("text"), F.array(F.struct(text(k % 20).alias("code")), F.struct(F.lit("").alias("code"))).alias("coding"))
    return resource(t.supplier, "Immunization", F.when(k % 7 != 0, text(k)), k, k, F.lit("s1"), vaccineCode=F.when(k % 5 != 0, code), status=F.lit("completed"), occurrenceDateTime=F.when(k % 2 == 0, "2021-01-01"), recorded=F.lit("2020-01-01"))


@register(
    "immunization_table",
    """
SELECT CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'pos-' || s_suppkey END AS id,
  CASE WHEN s_suppkey % 5 = 0 THEN CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'Immunization' END WHEN s_suppkey % 2 = 0 THEN 'Vaccine' ELSE CAST(s_suppkey % 20 AS VARCHAR) END AS label,
  CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 20 AS VARCHAR) ELSE '' END AS codes, CASE WHEN s_suppkey % 2 = 0 THEN '2021-01-01' ELSE '2020-01-01' END AS occurrence_date FROM supplier
""",
)
def immunization_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.immunizations(immunization_resources(Tables(spark, sf_dir))).select("id", "label", F.array_join("codes", ",").alias("codes"), "occurrence_date")


def encounter_resources(t: Tables) -> DataFrame:
    k, src = F.col("o_orderkey"), F.lit("s1")
    kind = F.when(k % 4 == 0, F.array(F.struct(F.lit("").alias("text")), F.struct(F.lit("Office visit").alias("text"))))
    reason = F.when(k % 4 == 1, F.array(F.struct(F.array(F.struct(F.lit("http://snomed.info/sct").alias("system"), F.lit("R1").alias("code"), F.lit("Cough").alias("display"))).alias("coding"))))
    cls = F.when(k % 4 == 2, F.struct(F.lit("AMB").alias("code")))
    provider = F.when(k % 5 != 0, F.struct(F.concat(pick(k % 2, "Organization/", "Practitioner/"), text(F.col("o_custkey") % 40)).alias("reference"), F.when(k % 3 == 0, "Shown place").alias("display")))
    visits = resource(
        t.orders, "Encounter", text(k), k, F.col("o_custkey"), src, type=kind, reasonCode=reason, serviceProvider=provider, status=F.lit("finished"),
        period=F.struct(F.when(k % 6 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("start"), F.lit("2030-01-01").alias("end")), **{"class": cls},
    )
    n = F.col("n_nationkey")
    orgs = resource(t.nation, "Organization", text(n), n, n, src, name=F.when(n % 6 != 0, F.col("n_name")))
    people = resource(t.nation, "Practitioner", text(n), n + 100, n, src, name=F.array(F.struct(F.array(F.lit("Jo"), F.lit("")).alias("given"), F.col("n_name").alias("family"))))
    return reduce(DataFrame.unionByName, [visits, orgs, people])


ENCOUNTER_SQL = """
e AS (SELECT o_orderkey AS k, o_orderdate, o_custkey % 40 AS ref FROM orders),
p AS (SELECT e.*, CASE WHEN k % 5 = 0 THEN NULL WHEN ref < 25 AND k % 2 = 0 AND ref % 6 <> 0 THEN n_name WHEN ref < 25 AND k % 2 = 1 THEN 'Jo ' || n_name WHEN k % 3 = 0 THEN 'Shown place'
        ELSE CASE k % 2 WHEN 0 THEN 'Organization/' ELSE 'Practitioner/' END || ref END AS provider FROM e LEFT JOIN nation ON n_nationkey = ref),
v AS (SELECT *, CASE k % 4 WHEN 0 THEN 'Office visit' WHEN 1 THEN 'Cough' WHEN 2 THEN 'AMB' ELSE coalesce(provider, CAST(k AS VARCHAR)) END AS label FROM p)
"""


@register(
    "encounter_table",
    f"WITH {ENCOUNTER_SQL} SELECT CAST(k AS VARCHAR) AS id, label, provider AS service_provider, CASE WHEN k % 4 = 2 THEN 'AMB' END AS class_label, CASE WHEN k % 4 = 1 THEN 'snomed:R1' ELSE '' END AS coding_keys, CASE WHEN k % 6 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS period_start FROM v",
)
def encounter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize.encounters(encounter_resources(Tables(spark, sf_dir)))
    return out.select("id", "label", "service_provider", "class_label", F.array_join("coding_keys", ",").alias("coding_keys"), "period_start")


def procedure_resources(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    code = F.struct(F.concat(F.lit("Proc "), "o_orderpriority").alias("text"), F.array(F.struct(F.lit("http://www.ama-assn.org/go/cpt").alias("system"), text(k % 90).alias("code"))).alias("coding"))
    reason = F.array(F.struct(F.array(F.struct(F.lit("http://hl7.org/fhir/sid/icd-10-cm").alias("system"), F.lit("Z00").alias("code"))).alias("coding")))
    return resource(
        t.orders, "Procedure", text(k), k, F.col("o_custkey"), F.lit("s1"), code=code, reasonCode=F.when(k % 3 == 0, reason), category=F.struct(F.lit("Surgery").alias("text")),
        performedDateTime=F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")), performedString=F.when(k % 3 == 1, "last year"), performedPeriod=F.struct(F.lit("2001-01-01").alias("end")),
    )


@register(
    "procedure_table",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Proc ' || o_orderpriority AS label, 'Surgery' AS category, 'cpt:' || (o_orderkey % 90) || CASE WHEN o_orderkey % 3 = 0 THEN ',icd10cm:Z00' ELSE '' END AS coding_keys,
  CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'last year' ELSE '2001-01-01' END AS performed_date FROM orders
""",
)
def procedure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.procedures(procedure_resources(Tables(spark, sf_dir))).select("id", "label", "category", F.array_join("coding_keys", ",").alias("coding_keys"), "performed_date")


def report_resources(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    results = F.when(k % 3 == 0, F.array(F.struct(F.lit("Observation/1").alias("reference")))).when(k % 3 == 1, F.array(*[F.struct(F.lit(f"Observation/{n}").alias("reference")) for n in (1, 2)]))
    return resource(
        t.part, "DiagnosticReport", text(k), k, k, F.lit("s1"), code=F.struct(F.col("p_name").alias("text")), category=F.array(F.struct(F.col("p_type").alias("text"))), result=results, issued=F.lit("2024-02-02"),
        conclusion=F.when(k % 5 == 0, F.concat(F.lit(" Fine "), "p_brand")), effectiveDateTime=F.when(k % 2 == 0, "2024-01-01"), status=F.lit("final"),
    )


@register(
    "report_table",
    """
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS label, p_type AS category, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS result_count, CASE WHEN p_partkey % 5 = 0 THEN 'Fine ' || p_brand END AS conclusion,
  CASE WHEN p_partkey % 2 = 0 THEN '2024-01-01' ELSE '2024-02-02' END AS effective_date FROM part
""",
)
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.diagnostic_reports(report_resources(Tables(spark, sf_dir))).select("id", "label", "category", "result_count", "conclusion", "effective_date")


def all_records(t: Tables) -> DataFrame:
    everything = reduce(
        DataFrame.unionByName,
        [medication_resources(t), allergy_resources(t), condition_resources(t), observation_resources(t), immunization_resources(t), encounter_resources(t), procedure_resources(t), report_resources(t)],
    )
    return records.unify({k: f(everything) for k, f in normalize.TYPED_TABLES.items()}, authored(t))


def authored(t: Tables) -> DataFrame:
    """Conversation turns as records a patient wrote down."""
    k = F.col("conv_id") * 1000 + F.col("turn")
    kind = pick(k % 4, "MedicationRequest", "Immunization", "AllergyIntolerance", "Condition")
    words = F.struct(F.concat(F.lit("Own "), "role").alias("text"), F.array(F.struct(F.lit("http://hl7.org/fhir/sid/cvx").alias("system"), F.lit("77").alias("code"))).alias("coding"))
    body = F.to_json(
        F.struct(
            F.when(k % 4 < 3, kind).alias("resourceType"), F.when(k % 4 == 0, words).alias("medicationCodeableConcept"), F.when(k % 4 == 1, words).alias("vaccineCode"), F.when(k % 4 == 2, words).alias("code"),
            F.array(F.struct(F.lit("one").alias("text")), F.struct(F.lit("two").alias("text"))).alias("dosageInstruction"), F.array(F.struct(F.lit("rash").alias("description"))).alias("reaction"),
            F.when(k % 8 == 2, "high").alias("criticality"), F.lit("active").alias("status"),
        )
    )
    flat = t.conversations.select(
        F.lit("own").alias("source_id"), text("conv_id").alias("patient_id"), k.alias("input_pos"), F.concat(F.lit("a"), text(k)).alias("id"), kind.alias("resource_type"), F.col("role").alias("label"), F.lit("kept").alias("status"),
        F.lit("2024-01-05").alias("authored_at"), body.alias("json"),
    )
    from ..functions.json_fields import parse_once

    return parse_once(flat, "json")


AUTHORED_SQL = """
c AS (SELECT conv_id * 1000 + turn AS k, role FROM conversations),
own AS (
  SELECT 'a' || k AS id, CASE k % 4 WHEN 0 THEN 'MedicationRequest' WHEN 1 THEN 'Immunization' WHEN 2 THEN 'AllergyIntolerance' ELSE 'Condition' END AS resource_type, CASE WHEN k % 4 = 3 THEN role ELSE 'Own ' || role END AS source_label,
    CASE WHEN k % 4 < 2 THEN 'active' ELSE 'kept' END AS status, CASE WHEN k % 4 < 2 THEN 'cvx:77' END AS coding_keys,
    CASE k % 4 WHEN 0 THEN 'one; two' WHEN 2 THEN CASE WHEN k % 8 = 2 THEN 'high · rash' ELSE 'rash' END END AS display_value,
    CASE k % 4 WHEN 0 THEN 'Own ' || role || ' Own ' || role || ' one; two cvx:77' WHEN 1 THEN 'Own ' || role || ' Own ' || role || ' cvx:77' WHEN 2 THEN 'Own ' || role || ' rash' || CASE WHEN k % 8 = 2 THEN ' high' ELSE '' END END AS grouping_text,
    '2024-01-05' AS date, 'patient' AS source FROM c)
"""


@register("authored_records", f"WITH {AUTHORED_SQL} SELECT * FROM own")
def authored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.authored_records(authored(Tables(spark, sf_dir)))
    return out.select("id", "resource_type", "source_label", "status", F.array_join("coding_keys", ",").alias("coding_keys"), "display_value", "grouping_text", "date", "source")


@register(
    "unified_records",
    f"""
WITH {ENCOUNTER_SQL}, {MEDICATION_SQL}, {AUTHORED_SQL},
u AS (
  SELECT 'provider' AS source, 'AllergyIntolerance' AS t, CASE WHEN c_custkey % 5 = 0 THEN 'high' END AS shown, {CUSTOMER_LABEL} AS label, CASE WHEN c_custkey % 2 = 0 THEN '2024-01-02' END AS date FROM customer
  UNION ALL SELECT 'provider', 'MedicationRequest', NULL, {MEDICATION_LABEL}, strftime(l_shipdate, '%Y-%m-%d') FROM j
  UNION ALL SELECT source, resource_type, display_value, source_label, date FROM own
  UNION ALL SELECT 'provider', 'Condition', NULL, {CUSTOMER_LABEL}, CASE WHEN c_custkey % 3 = 0 THEN '2024-03-01' WHEN c_custkey % 2 = 0 THEN '2023-05-01T10:00:00Z' END FROM customer
  UNION ALL SELECT 'provider', 'Observation', CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END || ' mg/dL', event_type, CASE WHEN event_id % 4 < 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END FROM events
  UNION ALL SELECT 'provider', 'Immunization', NULL, CASE WHEN s_suppkey % 5 = 0 THEN CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'Immunization' END WHEN s_suppkey % 2 = 0 THEN 'Vaccine' ELSE CAST(s_suppkey % 20 AS VARCHAR) END, CASE WHEN s_suppkey % 2 = 0 THEN '2021-01-01' ELSE '2020-01-01' END FROM supplier
  UNION ALL SELECT 'provider', 'Encounter', provider, label, CASE WHEN k % 6 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2030-01-01' END FROM v
  UNION ALL SELECT 'provider', 'Procedure', NULL, 'Proc ' || o_orderpriority, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'last year' ELSE '2001-01-01' END FROM orders
  UNION ALL SELECT 'provider', 'DiagnosticReport', CASE WHEN p_partkey % 5 = 0 THEN 'Fine ' || p_brand WHEN p_partkey % 3 = 0 THEN '1 linked result' WHEN p_partkey % 3 = 1 THEN '2 linked results' END, p_name, CASE WHEN p_partkey % 2 = 0 THEN '2024-01-01' ELSE '2024-02-02' END FROM part)
SELECT source, t AS resource_type, label, count(*) AS n, count(shown) AS n_shown, min(shown) AS first_shown, max(date) AS last_date FROM u GROUP BY ALL
""",
)
def unified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_records(Tables(spark, sf_dir))
    return rows.groupBy("source", "resource_type", F.col("source_label").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count("display_value").alias("n_shown"), F.min("display_value").alias("first_shown"), F.max("date").alias("last_date")
    )


# --- overlay, status and eligibility over orders

KINDS = ("MedicationRequest", "Condition", "AllergyIntolerance", "Encounter")
STATES = ("active", "On Hold", "Entered-in-Error", "resolved", "completed", "recurrence", "remission", "", "cancelled", "low")


def order_records(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return records.as_records(
        t.orders, patient_id=text("o_custkey"), input_pos=k, id=text(k), resource_type=pick(k % 4, *KINDS), source_label=F.col("o_orderpriority"), status=pick((k * 7 + F.col("o_custkey")) % 10, *STATES),
        date=F.date_format("o_orderdate", "yyyy-MM-dd"), source=F.lit("provider"),
    )


KIND_SQL = f"""
x AS (SELECT o_custkey, o_orderkey, {sql_pick('o_orderkey % 4', *KINDS)} AS t, {sql_pick('(o_orderkey * 7 + o_custkey) % 10', *STATES)} AS s FROM orders),
k AS (SELECT *, CASE
  WHEN t = 'MedicationRequest' THEN CASE s WHEN 'active' THEN 'active' WHEN 'On Hold' THEN 'on-hold' WHEN 'Entered-in-Error' THEN 'stopped' WHEN 'cancelled' THEN 'stopped' WHEN 'completed' THEN 'completed' ELSE 'unknown' END
  WHEN t = 'Condition' THEN CASE s WHEN 'active' THEN 'active' WHEN 'recurrence' THEN 'active' WHEN 'remission' THEN 'remission' WHEN 'resolved' THEN 'resolved' WHEN 'Entered-in-Error' THEN 'inactive' ELSE 'unknown' END
  WHEN t = 'AllergyIntolerance' THEN CASE s WHEN 'active' THEN 'active' WHEN '' THEN 'active' WHEN 'low' THEN 'active' WHEN 'resolved' THEN 'resolved' WHEN 'Entered-in-Error' THEN 'inactive' ELSE 'unknown' END
  ELSE 'unknown' END AS kind FROM x)
"""


@register("record_status", f"WITH {KIND_SQL} SELECT t AS resource_type, kind, kind IN ('active', 'on-hold') AS is_active, count(*) AS n FROM k GROUP BY ALL")
def record_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = records.status_kind(F.col("resource_type"), F.col("status"))
    rows = order_records(Tables(spark, sf_dir)).select("resource_type", kind.alias("kind"))
    return rows.groupBy("resource_type", "kind", records.kind_is_active(F.col("kind")).alias("is_active")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "group_status",
    f"WITH {KIND_SQL}, r AS (SELECT o_custkey, t, min(list_position(['active', 'on-hold', 'remission', 'resolved', 'inactive', 'stopped', 'completed', 'unknown'], kind)) AS p FROM k GROUP BY ALL) SELECT CAST(o_custkey AS VARCHAR) AS patient_id, t AS resource_type, ['active', 'on-hold', 'remission', 'resolved', 'inactive', 'stopped', 'completed', 'unknown'][p] AS status_kind FROM r",
)
def group_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.grouping import group_status as rollup

    return rollup(order_records(Tables(spark, sf_dir)), ["patient_id", "resource_type"])


@register(
    "patch_overlay",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 10 = 0 AND o_orderkey % 4 = 0 AS hidden, o_orderkey % 15 = 0 AND o_orderkey % 4 = 1 AS inactive_overlay FROM orders
""",
)
def patch_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    k = F.col("o_orderkey")
    patch = lambda rtype, field, value: t.orders.select(text("o_custkey").alias("patient_id"), F.lit(rtype).alias("target_type"), text(k).alias("target_id"), F.lit(field).alias("field"), F.lit(value).alias("value"))
    patches = patch("MedicationRequest", "patientRecordVisibility", "hidden").filter("target_id % 10 = 0").unionByName(patch("Condition", "patientRecordStatus", "inactive").filter("target_id % 15 = 0")).unionByName(patch("Condition", "note", "hidden"))
    return records.overlay_patches(order_records(t), patches).select("id", "hidden", "inactive_overlay")


@register("visible_records", "SELECT CAST(o_orderkey % 4 AS INTEGER) AS k, count(*) AS n FROM orders WHERE NOT (o_orderkey % 10 = 0 AND o_orderkey % 4 = 0) GROUP BY ALL")
def visible_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_records(Tables(spark, sf_dir)).withColumn("k", (F.col("input_pos") % 4).cast("int")).withColumn("hidden", F.when((F.col("input_pos") % 10 == 0) & (F.col("k") == 0), True))
    return records.visible(rows).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@register(
    "eligible_observations",
    """
SELECT user_id AS patient_id, count(*) AS n FROM events WHERE event_id % 5 IN (0, 1, 2) AND event_id % 7 NOT IN (3, 4) AND event_id % 11 <> 0 GROUP BY ALL
""",
)
def eligible_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = Tables(spark, sf_dir).events.select(
        F.col("user_id").alias("patient_id"), F.lit("Observation").alias("resource_type"), pick(k % 5, "Final", "amended", " corrected ", "preliminary", None).alias("status"),
        pick(k % 7, "quantity", None, "string", "absent", "unknown", "period", "integer").alias("value_kind"), (k % 11 == 0).alias("hidden"), F.lit(False).alias("inactive_overlay"),
    )
    return records.relationship_eligible(rows).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
