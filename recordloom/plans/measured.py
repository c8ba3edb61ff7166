"""Checked queries over ``events`` read as observations: user = patient, event type = concept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import json_fields
from ..operators import dedupe, grouping, normalize, ranges, records, state, trends
from .registry import Tables, iso_seconds, pick, register, sql_pick, text

# Last instant of interest for rules that need a "now": end of the event month.
NOW_MS = 1_706_745_600_000
EVENT_DATE_SQL = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"


def event_points(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("patient_id"), F.col("event_type").alias("concept"), "value",
        F.when(F.col("event_id") % 4 == 0, "mg").otherwise("g").alias("unit"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("date"), F.col("event_id").alias("input_pos"),
    )


POINTS_SQL = """
p AS (SELECT user_id AS patient_id, event_type AS concept, value, CASE WHEN event_id % 4 = 0 THEN 'mg' ELSE 'g' END AS unit, ts, event_id FROM events)
"""


@register(
    "trend_detection",
    f"""
WITH {POINTS_SQL},
u AS (SELECT patient_id, concept, unit, count(*) AS n, min(ts) AS t0 FROM p WHERE value IS NOT NULL AND isfinite(value) GROUP BY ALL),
c AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY patient_id, concept ORDER BY n DESC, t0) = 1),
r AS (
  SELECT patient_id, concept, unit, value, lag(value, 1) OVER w AS prev, lag(value, 2) OVER w AS third,
         row_number() OVER (PARTITION BY patient_id, concept, unit ORDER BY ts DESC, event_id DESC) AS rn
  FROM p WHERE value IS NOT NULL AND isfinite(value) WINDOW w AS (PARTITION BY patient_id, concept, unit ORDER BY ts, event_id))
SELECT c.patient_id, c.concept, c.unit, c.n AS point_count,
       CASE WHEN prev - third > 0 AND value - prev > 0 THEN 'up' WHEN prev - third < 0 AND value - prev < 0 THEN 'down' ELSE 'none' END AS direction,
       value AS latest, prev AS previous, CASE WHEN prev <> 0 THEN CAST(floor((value - prev) / abs(prev) * 100 + 0.5) AS BIGINT) END AS percent_change
FROM c JOIN r ON c.patient_id = r.patient_id AND c.concept = r.concept AND c.unit = r.unit WHERE rn = 1
""",
)
def trend_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.detect_trends(event_points(Tables(spark, sf_dir)), ["patient_id", "concept"])


@register(
    "largest_unit_group",
    f"""
WITH {POINTS_SQL}, u AS (SELECT patient_id, concept, unit, count(*) AS n, min(ts) AS t0 FROM p GROUP BY ALL)
SELECT patient_id, concept, unit, n AS point_count FROM u QUALIFY row_number() OVER (PARTITION BY patient_id, concept ORDER BY n DESC, t0) = 1
""",
)
def largest_unit_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.largest_unit(event_points(Tables(spark, sf_dir)), ["patient_id", "concept"])


@register(
    "observation_tracking",
    f"""
WITH o AS (SELECT user_id AS patient_id, event_type AS concept, {EVENT_DATE_SQL} AS date, concat('v', event_id) AS display,
                  CASE WHEN event_id % 7 <> 0 THEN value END AS num, CASE WHEN user_id % 3 = 0 AND event_id % 5 = 0 THEN NULL ELSE 'mg' END AS unit, event_id FROM events)
SELECT patient_id, concept, count(*) AS n,
       arg_max(display, date || lpad(CAST(1000000000 - event_id AS VARCHAR), 12, '0')) AS latest, min(num) AS min_value, max(num) AS max_value,
       max(CASE WHEN num IS NOT NULL THEN unit END) AS unit,
       count(num) >= 2 AND count(DISTINCT CASE WHEN num IS NOT NULL THEN coalesce(unit, 'unitless') END) = 1 AS chartable
FROM o GROUP BY ALL
""",
)
def observation_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).events.select(
        F.col("user_id").alias("patient_id"), F.col("event_type").alias("concept"), iso_seconds("ts").alias("date"),
        F.concat(F.lit("v"), text("event_id")).alias("display"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("numeric"),
        F.when(~((F.col("user_id") % 3 == 0) & (F.col("event_id") % 5 == 0)), "mg").alias("unit"),
        F.col("event_id").alias("input_pos"), F.lit(True).alias("readable"),
    )
    return trends.tracking(rows, ["patient_id", "concept"])


@register(
    "latest_group_value",
    f"""
WITH m AS (SELECT user_id AS patient_id, event_type AS concept, CASE WHEN user_id % 4 = 0 THEN NULL ELSE {EVENT_DATE_SQL} END AS od, concat('v', event_id) AS ov, strftime(ts, '%Y-%m-%d') AS rd, event_id FROM events),
o AS (SELECT patient_id, concept, od, ov FROM m WHERE od IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patient_id, concept ORDER BY od DESC, event_id) = 1),
r AS (SELECT patient_id, concept, rd, ov FROM m QUALIFY row_number() OVER (PARTITION BY patient_id, concept ORDER BY rd DESC, event_id) = 1)
SELECT r.patient_id, r.concept, coalesce(o.od, r.rd) AS latest_date, coalesce(o.ov, r.ov) AS latest_value FROM r LEFT JOIN o ON o.patient_id = r.patient_id AND o.concept = r.concept
""",
)
def latest_group_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).events.select(
        F.col("user_id").alias("patient_id"), F.col("event_type").alias("concept"),
        F.when(F.col("user_id") % 4 != 0, iso_seconds("ts")).alias("observation_date"), F.concat(F.lit("v"), text("event_id")).alias("observation_value"),
        F.date_format("ts", "yyyy-MM-dd").alias("record_date"), F.col("event_id").alias("member_pos"),
    )
    return trends.latest_values(rows, ["patient_id", "concept"])


@register(
    "latest_timestamp",
    "SELECT user_id AS patient_id, event_type AS concept, max(epoch_ms(date_trunc('second', ts))) AS latest_ms, count(*) AS n_records FROM events GROUP BY ALL",
)
def latest_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).events.select(F.col("user_id").alias("patient_id"), F.col("event_type").alias("concept"), iso_seconds("ts").alias("date"), F.lit(None).cast("string").alias("latest_date"))
    return trends.latest_timestamps(rows, ["patient_id", "concept"])


@register(
    "newest_observations",
    f"""
SELECT user_id AS patient_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {EVENT_DATE_SQL} DESC, event_id) AS INTEGER) AS position
FROM events QUALIFY position <= 25
""",
)
def newest_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).events.select(F.col("user_id").alias("patient_id"), "event_id", iso_seconds("ts").alias("date"), F.col("event_id").alias("input_pos"))
    return trends.newest_observations(rows).select("patient_id", "event_id", "position")


@register(
    "date_sections",
    "SELECT user_id AS patient_id, strftime(ts, '%b %-d, %Y') AS section, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY ALL",
)
def date_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).events.select(F.col("user_id").alias("patient_id"), F.date_format("ts", "MMM d, yyyy").alias("section"), "event_id")
    return rows.groupBy("patient_id", "section").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


CATEGORY_OPTIONS = ("laboratory", "Vital Signs", "vital-sign", "imaging", None, "LAB", "")


@register(
    "observation_bucket_counts",
    f"""
WITH c AS (SELECT user_id AS patient_id, {sql_pick('event_id % 7', *CATEGORY_OPTIONS)} AS category FROM events),
d AS (SELECT patient_id, regexp_replace(lower(coalesce(category, '')), '[^a-z0-9]+', '-', 'g') AS k FROM c),
b AS (SELECT patient_id, CASE WHEN k IN ('laboratory', 'lab') THEN 'labs' WHEN k IN ('vital-signs', 'vital-sign') THEN 'vitals' ELSE 'other' END AS bucket FROM d)
SELECT patient_id, count(*) FILTER (bucket = 'labs') AS labs, count(*) FILTER (bucket = 'vitals') AS vitals, count(*) FILTER (bucket = 'other') AS other FROM b GROUP BY ALL
""",
)
def observation_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).events.select(F.col("user_id").alias("patient_id"), pick(F.col("event_id") % 7, *CATEGORY_OPTIONS).alias("category"))
    bucket = F.coalesce(records.bucket_from_category(F.col("category"), F.lit(None).cast("string")), F.lit("other"))
    return grouping.category_counts(rows.withColumn("bucket", bucket), "bucket", ["labs", "vitals", "other"], ["patient_id"])


@register(
    "bucket_agreement",
    f"""
WITH c AS (SELECT user_id AS patient_id, event_type AS concept, CASE WHEN event_type < 'k' THEN 'laboratory' ELSE {sql_pick('user_id % 3', 'laboratory', 'vital-signs', 'imaging')} END AS a,
                  CASE WHEN event_id % 50 = 0 AND user_id % 2 = 0 THEN 'vital-signs' END AS b FROM events),
d AS (SELECT patient_id, concept, CASE coalesce(b, a) WHEN 'laboratory' THEN 'labs' WHEN 'vital-signs' THEN 'vitals' END AS bucket FROM c)
SELECT patient_id, concept, CASE WHEN count(DISTINCT bucket) = 1 THEN max(bucket) END AS bucket FROM d GROUP BY ALL
""",
)
def bucket_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("event_type") < "k", "laboratory").otherwise(pick(F.col("user_id") % 3, "laboratory", "vital-signs", "imaging"))
    code = F.when((F.col("event_id") % 50 == 0) & (F.col("user_id") % 2 == 0), "vital-signs")
    rows = Tables(spark, sf_dir).events.select(F.col("user_id").alias("patient_id"), F.col("event_type").alias("concept"), records.record_bucket(F.lit("Observation"), category, code).alias("bucket"))
    return rows.groupBy("patient_id", "concept").agg(grouping.bucket_agreement().alias("bucket"))


def _value_body(kind: Column) -> Column:
    """One observation resource as JSON text, its value in one of nine shapes."""
    null = F.lit(None).cast("string")
    quantity = F.struct(F.col("value").alias("value"), pick(F.col("event_id") % 4, " lb", "cm", "%", None).alias("unit"), pick(F.col("event_id") % 5, "[lb_av]", None, None, "[degF]", "kg").alias("code"), F.when(F.col("event_id") % 11 == 0, "<").alias("comparator"))
    concept = F.struct(F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("event_type")).alias("text"), F.array(F.struct(null.alias("display"), F.lit("c0").alias("code")), F.struct(F.lit("Positive").alias("display"), F.lit("c1").alias("code"))).alias("coding"))
    reason = F.struct(F.lit("Not asked").alias("text"))
    codes = F.array(F.struct(F.array(F.struct(pick(F.col("event_id") % 4, "N", "h", "normal", None).alias("code"))).alias("coding")))
    low_type = "struct<value:bigint,unit:string>"
    low = F.when(F.col("event_id") % 3 != 0, F.struct(F.floor("value").alias("value"), F.lit("mg/dL").alias("unit")))
    high = F.when(F.col("event_id") % 5 == 0, F.struct(F.ceil("value").alias("value"), F.lit("g/L").alias("unit")))
    span = F.when(F.col("event_id") % 10 == 9, " normal ")
    ranges_ = F.array(F.struct(F.lit(None).cast(low_type).alias("low"), F.lit(None).cast(low_type).alias("high"), null.alias("text")), F.struct(low.alias("low"), high.alias("high"), span.alias("text")))
    return F.to_json(
        F.struct(
            F.lit("Observation").alias("resourceType"), text("event_id").alias("id"),
            F.when(kind == 0, quantity).alias("valueQuantity"), F.when(kind == 1, concept).alias("valueCodeableConcept"), F.when(kind == 2, F.col("event_type")).alias("valueString"),
            F.when(kind == 3, F.col("event_id") % 2 == 0).alias("valueBoolean"), F.when(kind == 4, F.col("user_id")).alias("valueInteger"), F.when(kind == 5, iso_seconds("ts")).alias("valueDateTime"),
            F.when(kind == 6, F.struct(F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).alias("start"), F.lit("2024-02-01").alias("end"))).alias("valuePeriod"),
            F.when(kind == 7, reason).alias("dataAbsentReason"),
            codes.alias("interpretation"), ranges_.alias("referenceRange"),
        )
    )


@register(
    "observation_values",
    f"""
WITH e AS (
  SELECT *, event_id % 9 AS kind, trim({sql_pick('event_id % 4', ' lb', 'cm', '%', None)}) AS u, {sql_pick('event_id % 5', '[lb_av]', None, None, '[degF]', 'kg')} AS c FROM events),
v AS (
  SELECT event_id,
    {sql_pick('kind', 'quantity', 'codeable-concept', 'string', 'boolean', 'integer', 'datetime', 'period', 'absent', 'unknown')} AS kind,
    CASE kind WHEN 0 THEN concat_ws(' ', CASE WHEN event_id % 11 = 0 THEN '<' END, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END, coalesce(u, c))
      WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'Positive' ELSE event_type END WHEN 2 THEN event_type WHEN 3 THEN CAST(event_id % 2 = 0 AS VARCHAR)
      WHEN 4 THEN CAST(user_id AS VARCHAR) WHEN 5 THEN {EVENT_DATE_SQL}
      WHEN 6 THEN CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') || ' to 2024-02-01' ELSE '2024-02-01' END WHEN 7 THEN 'Not asked' ELSE 'No value recorded' END AS display,
    CASE kind WHEN 0 THEN value WHEN 4 THEN CAST(user_id AS DOUBLE) END AS numeric_value,
    CASE WHEN kind = 0 THEN CASE coalesce(c, u) WHEN '[lb_av]' THEN value * 0.45359237 WHEN 'lb' THEN value * 0.45359237 WHEN '[degF]' THEN (value - 32) / 1.8 WHEN 'kg' THEN value WHEN 'cm' THEN value WHEN '%' THEN value END END AS cv,
    CASE WHEN kind = 0 THEN CASE coalesce(c, u) WHEN '[lb_av]' THEN 'kg' WHEN 'lb' THEN 'kg' WHEN '[degF]' THEN 'Cel' WHEN 'kg' THEN 'kg' WHEN 'cm' THEN 'cm' WHEN '%' THEN '%' END END AS canonical_unit,
    event_id % 4 = 1 AS abnormal,
    CASE WHEN event_id % 3 <> 0 THEN floor(value) END AS lo, CASE WHEN event_id % 5 = 0 THEN ceil(value) END AS hi, CASE WHEN event_id % 10 = 9 THEN 'normal' END AS tx
  FROM e)
SELECT event_id, kind, display, numeric_value, round(cv, 6) AS canonical_value, canonical_unit, abnormal, lo AS range_low, hi AS range_high,
       CASE WHEN lo IS NOT NULL THEN 'mg/dL' WHEN hi IS NOT NULL THEN 'g/L' END AS range_unit, tx AS range_text
FROM v
""",
)
def observation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Tables(spark, sf_dir).heavy("events")
    rows = json_fields.parse_once(events.select("event_id", _value_body(F.col("event_id") % 9).alias("json")), "json")
    body = F.col("body")
    parts = rows.select("event_id", "body", normalize.value_fields(body).alias("parts"))
    made = parts.select("event_id", normalize.observation_value(F.col("parts")).alias("v"), normalize.abnormal_flag(body).alias("abnormal"), normalize.resource_range(body).alias("r"))
    return made.select(
        "event_id", "v.kind", "v.display", "v.numeric_value", F.round("v.canonical_value", 6).alias("canonical_value"), "v.canonical_unit", "abnormal",
        F.col("r.low").alias("range_low"), F.col("r.high").alias("range_high"), F.col("r.unit").alias("range_unit"), F.col("r.text").alias("range_text"),
    )


UNIT_CYCLE = ("kg", "Grams", "lbs", "m", "inch", "C", "°F", "mm[Hg]", "/min", "mg/dL")


@register(
    "canonical_units",
    f"""
WITH e AS (SELECT event_id, value, {sql_pick('event_id % 10', *UNIT_CYCLE)} AS unit FROM events)
SELECT unit, {sql_pick("list_position(['" + "','".join(UNIT_CYCLE) + "'], unit) - 1", 'kg', 'kg', 'kg', 'cm', 'cm', 'Cel', 'Cel', 'mm[Hg]', '/min', None)} AS canonical_unit, count(*) AS n,
       round(sum(CASE unit WHEN 'kg' THEN value WHEN 'Grams' THEN value / 1000 WHEN 'lbs' THEN value * 0.45359237 WHEN 'm' THEN value * 100 WHEN 'inch' THEN value * 2.54 WHEN 'C' THEN value
                      WHEN '°F' THEN (value - 32) / 1.8 WHEN 'mm[Hg]' THEN value WHEN '/min' THEN value END), 4) AS total
FROM e GROUP BY ALL
""",
)
def canonical_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).events.select("value", pick(F.col("event_id") % 10, *UNIT_CYCLE).alias("unit"))
    q = normalize.canonical_quantity(F.col("value"), F.col("unit"), F.lit(None).cast("string"))
    return rows.select("unit", q["unit"].alias("canonical_unit"), q["value"].alias("v")).groupBy("unit", "canonical_unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


def _ranged_events(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("patient_id"), F.col("event_type").alias("group_id"), iso_seconds("ts").alias("date"), F.col("event_id").alias("input_pos"),
        F.when(F.col("event_id") % 3 == 0, F.floor("value").cast("double")).alias("low"), F.when(F.col("event_id") % 4 == 0, F.floor("value").cast("double") + 20).alias("high"),
        F.when(F.col("event_id") % 2 == 0, "mg/dL").alias("unit"), F.lit("mg").alias("ucum_code"), F.lit(None).cast("string").alias("text"),
    )


OWN_RANGE_SQL = f"""
x AS (SELECT user_id AS patient_id, event_type AS group_id, {EVENT_DATE_SQL} AS date, event_id, CASE WHEN event_id % 3 = 0 THEN floor(value) END AS low,
             CASE WHEN event_id % 4 = 0 THEN floor(value) + 20 END AS high, CASE WHEN event_id % 2 = 0 THEN 'mg/dL' ELSE 'mg' END AS unit FROM events),
own AS (SELECT patient_id, group_id, coalesce(low, CAST('-inf' AS DOUBLE)) AS low, coalesce(high, CAST('inf' AS DOUBLE)) AS high, unit FROM x
        WHERE low IS NOT NULL OR high IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patient_id, group_id ORDER BY date DESC, event_id) = 1)
"""


@register("latest_resource_range", f"WITH {OWN_RANGE_SQL} SELECT patient_id, group_id, CAST(low AS VARCHAR) AS low, CAST(high AS VARCHAR) AS high, unit FROM own")
def latest_resource_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trends.latest_usable_range(_ranged_events(Tables(spark, sf_dir)), ["patient_id", "group_id"])
    shown = lambda c: F.when(F.col(c) == float("inf"), "inf").when(F.col(c) == float("-inf"), "-inf").otherwise(F.col(c).cast("string"))
    return out.select("patient_id", "group_id", shown("low").alias("low"), shown("high").alias("high"), "unit")


@register(
    "reference_range_resolution",
    f"""
WITH {OWN_RANGE_SQL},
pt AS (SELECT DISTINCT user_id AS patient_id, {sql_pick('user_id % 3', 'male', 'female', 'other')} AS sex, user_id % 90 AS age FROM events WHERE user_id % 90 >= 18),
g AS (SELECT DISTINCT user_id AS patient_id, event_type AS group_id FROM events),
own1 AS (SELECT * FROM own WHERE patient_id % 2 = 0),
t AS (SELECT event_type AS group_id, min(value) AS lo, avg(value) AS mid, max(value) AS hi FROM events GROUP BY ALL)
SELECT g.patient_id, g.group_id,
  CASE WHEN o.patient_id IS NOT NULL THEN 'resource' ELSE 'table' END AS source,
  CASE WHEN o.patient_id IS NOT NULL THEN o.unit ELSE 'mg/dL' END AS unit,
  CAST(CASE WHEN o.patient_id IS NOT NULL THEN o.low ELSE round(CASE WHEN pt.sex = 'male' THEN t.lo ELSE t.lo + 1 END, 2) END AS VARCHAR) AS low
FROM g JOIN pt USING (patient_id) LEFT JOIN own1 o ON o.patient_id = g.patient_id AND o.group_id = g.group_id LEFT JOIN t ON t.group_id = g.group_id
WHERE o.patient_id IS NOT NULL OR pt.sex IN ('male', 'female') OR t.group_id = 'error'
""",
)
def reference_range_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    observations = _ranged_events(t)
    patients = t.events.select(F.col("user_id").alias("patient_id"), pick(F.col("user_id") % 3, "male", "female", "other").alias("sex"), (F.col("user_id") % 90).alias("age")).distinct()
    even = F.col("group_id") < "f"
    groups = observations.select("patient_id", "group_id").distinct().select(
        "patient_id", "group_id", F.upper("group_id").alias("name"), F.lit(None).cast("string").alias("canonical_system"), F.lit(None).cast("string").alias("canonical_code")
    )
    codes = observations.filter(even).select("patient_id", "group_id", F.concat(F.lit("alt-"), "group_id").alias("code"), F.col("input_pos").alias("code_pos"))
    bound = lambda lo, hi: F.struct(F.round(lo, 2).alias("low"), hi.alias("high"))
    table = t.events.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).select(
        F.col("event_type").alias("range_id"), F.concat(F.lit("code-"), "event_type").alias("code"), F.array(F.concat(F.lit("alt-"), "event_type")).alias("alternate_codes"),
        F.concat(F.lit("The "), "event_type").alias("name"), F.array("event_type").alias("aliases"), F.lit("mg/dL").alias("unit"), F.lit(None).cast("double").alias("molecular_weight"),
        bound(F.col("lo"), F.col("hi")).alias("male"), bound(F.col("lo") + 1, F.col("hi")).alias("female"),
        F.when(F.col("event_type") == "error", bound(F.col("lo") + 1, F.col("hi"))).alias("default"),
    )
    own = observations.filter(F.col("patient_id") % 2 == 0)
    out = ranges.group_ranges(groups, own, codes, table, patients)
    shown = F.when(F.col("low") == float("-inf"), "-inf").otherwise(F.col("low").cast("string"))
    return out.select("patient_id", "group_id", "source", "unit", shown.alias("low"))


CONVERSIONS = [("mg/dL", "g/L", None), ("mg/dL", "mmol/L", 180.16), ("Cel", "[degF]", None), ("kg", "[lb_av]", None), ("mg/dL", "mmol/L", None), ("mmol/L", "mg/dL", 180.16), ("furlong", "m", None), ("%", "%", None)]


@register(
    "unit_conversion",
    """
WITH e AS (SELECT event_id % 8 AS k, value FROM events)
SELECT CAST(k AS BIGINT) AS k, count(*) AS n, count(c) AS n_converted, round(sum(c), 4) AS total FROM (
  SELECT k, CASE k WHEN 0 THEN value * 0.01 WHEN 1 THEN value * 0.01 / 180.16 / 0.001 WHEN 2 THEN value * 1.8 + 32 WHEN 3 THEN value * 1000 / 453.59237 WHEN 5 THEN value * 0.001 * 180.16 / 0.01 WHEN 7 THEN value END AS c FROM e)
GROUP BY ALL
""",
)
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 8
    weight = F.when(k.isin(*[i for i, c in enumerate(CONVERSIONS) if c[2]]), 180.16)
    rows = Tables(spark, sf_dir).events.select(k.alias("k"), "value", pick(k, *[c[0] for c in CONVERSIONS]).alias("f"), pick(k, *[c[1] for c in CONVERSIONS]).alias("t"), weight.alias("mw"))
    made = ranges.convert_units(rows, "value", "f", "t", "c", "mw")
    return made.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count("c").alias("n_converted"), F.round(F.sum("c"), 4).alias("total"))


@register(
    "out_of_range_flags",
    """
WITH e AS (SELECT user_id AS patient_id, event_type AS group_id, value,
  CASE WHEN user_id % 4 = 0 AND event_id % 40 = 0 THEN NULL WHEN event_id % 2 = 0 THEN value BETWEEN 0.5 AND 200 ELSE value * 0.01 BETWEEN 0.005 AND 2 END AS ok FROM events)
SELECT patient_id, group_id, CASE WHEN count(*) FILTER (ok = false) > 0 THEN true WHEN count(*) FILTER (ok IS NULL) > 0 THEN NULL ELSE false END AS out_of_range FROM e GROUP BY ALL
""",
)
def out_of_range_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    odd_unit = (F.col("user_id") % 4 == 0) & (F.col("event_id") % 40 == 0)
    rows = Tables(spark, sf_dir).events.select(
        F.col("user_id").alias("patient_id"), F.col("event_type").alias("group_id"), "value", F.when(odd_unit, "furlong").otherwise(F.when(even, "MG/L").otherwise("mg/dL")).alias("unit"),
        F.when(even, 0.5).otherwise(0.005).alias("low"), F.when(even, 200.0).otherwise(2.0).alias("high"), F.when(even, "mg/L").otherwise("g/L").alias("range_unit"),
    )
    return ranges.out_of_range_groups(ranges.in_range(rows), ["patient_id", "group_id"])


def copies(t: Tables) -> DataFrame:
    """Observations seen through three portals: events of one user, type and whole value are candidates."""
    return records.as_records(
        t.heavy("events").withColumns({"_u": F.col("user_id") % 40, "_p": F.col("event_id") % 3}),
        patient_id=text("_u"), input_pos=F.col("event_id"), id=F.concat(F.lit("e"), F.lpad(text("event_id"), 10, "0")), resource_type=F.lit("Observation"), source_label=F.col("event_type"),
        status=F.when(F.col("event_id") % 97 == 0, "cancelled").when(F.col("event_id") % 31 == 0, "").otherwise("final"),
        date=F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        canonical_value=F.floor(F.col("value") / 20).cast("double"), canonical_unit=F.lit("kg"), display_value=F.lit("x"),
        portal_source_id=F.concat(F.lit("p"), text("_p")), source=F.when(F.col("event_id") % 53 == 0, "patient").otherwise("provider"), hidden=F.lit(False),
        coding_keys=F.when(F.col("event_id") % 2 == 0, F.array(F.lit("loinc:1-1"))),
    ).withColumn("group_id", F.col("source_label"))


COPIES_SQL = """
r AS (
  SELECT CAST(user_id % 40 AS VARCHAR) AS patient_id, event_type AS group_id, event_id, 'e' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS id,
    CASE WHEN event_id % 97 = 0 THEN 'cancelled' WHEN event_id % 31 = 0 THEN '' ELSE 'ok' END AS st, event_id % 5 <> 0 AS timed,
    epoch_ms(date_trunc('second', ts)) AS ms, strftime(ts, '%Y-%m-%d') AS day, epoch_ms(date_trunc('day', ts)) AS day_ms,
    CAST(floor(value / 20) AS BIGINT) AS v, event_id % 3 AS portal, event_id % 53 <> 0 AS provider
  FROM events),
q AS (SELECT *, CASE WHEN timed THEN ms ELSE day_ms END AS instant FROM r),
pairs AS (
  SELECT a.patient_id, a.group_id, a.v, a.id AS a_id, b.id AS b_id, a.timed AND b.timed AS both_timed
  FROM q a JOIN q b ON a.patient_id = b.patient_id AND a.group_id = b.group_id AND a.v = b.v AND a.portal <> b.portal AND a.provider AND b.provider
    AND (a.instant > b.instant OR (a.instant = b.instant AND a.event_id < b.event_id))
    AND (a.st = '' OR b.st = '' OR a.st = b.st)
    AND CASE WHEN a.timed AND b.timed THEN abs(a.ms - b.ms) <= 300000 OR (abs(a.ms - b.ms) <= 14400000 AND (a.ms // 1000) % 3600 = (b.ms // 1000) % 3600) ELSE a.day = b.day END)
"""


@register(
    "duplicate_pair_counts",
    f"WITH {COPIES_SQL} SELECT patient_id, group_id, v AS value, CASE WHEN both_timed THEN 'time' ELSE 'day' END AS rule, count(*) AS n_pairs FROM pairs GROUP BY ALL",
)
def duplicate_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe.matching_pair_counts(copies(Tables(spark, sf_dir)))
    return out.select("patient_id", "group_id", F.floor(F.split_part("value_key", F.lit("|"), F.lit(1)).cast("double")).alias("value"), "rule", F.col("n_pairs").cast("bigint").alias("n_pairs"))


CLUSTERS_SQL = f"""
{COPIES_SQL},
pos AS (SELECT q.*, row_number() OVER (ORDER BY instant DESC, event_id) AS pos,
  CASE WHEN provider THEN 5 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 22 ELSE 0 END + CASE WHEN event_id % 97 <> 0 AND event_id % 31 = 0 THEN 0 ELSE 3 END + CASE WHEN timed THEN 6 ELSE 3 END + 26 AS quality FROM q),
edge AS (SELECT p1.pos AS a, p2.pos AS b, pairs.both_timed FROM pairs JOIN pos p1 ON p1.id = pairs.a_id JOIN pos p2 ON p2.id = pairs.b_id),
reach AS (
  SELECT pos AS n, pos AS root FROM pos WHERE pos NOT IN (SELECT b FROM edge)
  UNION SELECT e.b AS n, reach.root FROM reach JOIN edge e ON e.a = reach.n),
lead AS (SELECT n, min(root) AS leader FROM reach GROUP BY n),
full_rows AS (
  SELECT pos.*, lead.leader, l.id AS leader_id
  FROM pos JOIN lead ON lead.n = pos.pos JOIN pos l ON l.pos = lead.leader)
"""


@register(
    "duplicate_clusters",
    f"""
WITH RECURSIVE {CLUSTERS_SQL},
canon AS (SELECT leader, id AS canonical_id, quality FROM full_rows QUALIFY row_number() OVER (PARTITION BY leader ORDER BY quality DESC, instant DESC, id) = 1),
second AS (SELECT leader, timed FROM full_rows WHERE pos <> leader QUALIFY row_number() OVER (PARTITION BY leader ORDER BY pos) = 1)
SELECT any_value(f.patient_id) AS patient_id, any_value(f.group_id) AS group_id, f.leader_id, count(*) - 1 AS duplicate_count, any_value(c.canonical_id) AS canonical_id, any_value(c.quality) AS quality_score,
  CASE WHEN any_value(s.timed) IS NULL THEN NULL WHEN any_value(s.timed) AND any_value(l.timed) THEN 'Same concept, same value/unit, and matching time within 4 hours.'
       ELSE 'Same concept, same value/unit, and same calendar date.' END AS match_reason
FROM full_rows f JOIN canon c ON c.leader = f.leader LEFT JOIN second s ON s.leader = f.leader JOIN pos l ON l.pos = f.leader GROUP BY f.leader_id
""",
)
def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, _ = dedupe.dedupe(copies(Tables(spark, sf_dir)))
    return clusters.select("patient_id", "group_id", "leader_id", "duplicate_count", "canonical_id", "quality_score", "match_reason")


@register(
    "duplicate_chips",
    f"""
WITH RECURSIVE {CLUSTERS_SQL},
canon AS (SELECT leader, portal AS home FROM full_rows QUALIFY row_number() OVER (PARTITION BY leader ORDER BY quality DESC, instant DESC, id) = 1),
s AS (SELECT f.leader_id, count(*) AS n, list_distinct(list(f.portal) FILTER (f.portal <> c.home)) AS others FROM full_rows f JOIN canon c ON c.leader = f.leader GROUP BY f.leader_id HAVING count(*) > 1)
SELECT leader_id, CASE WHEN len(others) = 1 THEN 'Also in p' || others[1] ELSE n || ' matching records' END AS chip FROM s
""",
)
def duplicate_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, members = dedupe.dedupe(copies(Tables(spark, sf_dir)))
    chips = grouping.duplicate_chip(members)
    return chips.join(clusters.select("patient_id", "cluster_id", "leader_id"), ["patient_id", "cluster_id"]).select("leader_id", "chip")


@register(
    "group_cards",
    f"""
WITH RECURSIVE {CLUSTERS_SQL},
canon AS (SELECT leader, patient_id, group_id, CASE WHEN timed THEN strftime(make_timestamp_ms(ms), '%Y-%m-%dT%H:%M:%SZ') ELSE day END AS date FROM full_rows
          QUALIFY row_number() OVER (PARTITION BY leader ORDER BY quality DESC, instant DESC, id) = 1),
a AS (SELECT patient_id, group_id, count(*) AS n_records, max(date) AS latest_date FROM canon GROUP BY ALL),
b AS (SELECT patient_id, group_id, count(*) AS n, count(DISTINCT portal) AS n_portals FROM full_rows GROUP BY ALL)
SELECT a.patient_id, a.group_id, a.n_records, b.n - a.n_records AS n_duplicates, a.latest_date, b.n_portals FROM a JOIN b ON a.patient_id = b.patient_id AND a.group_id = b.group_id
""",
)
def group_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = copies(Tables(spark, sf_dir))
    clusters, _ = dedupe.dedupe(rows)
    return grouping.group_cards(clusters, rows, ["patient_id", "group_id"])


@register(
    "last_write_wins",
    """
SELECT user_id, event_type, event_id, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
""",
)
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Tables(spark, sf_dir).events
    old = events.filter("event_id % 10 <> 9")
    new = events.filter("event_id % 10 = 9")
    merged = state.upsert(old, new, ["user_id", "event_type"], ["ts", "event_id"])
    return merged.select("user_id", "event_type", "event_id", "value", "props")
