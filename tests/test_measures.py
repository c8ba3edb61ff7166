import pytest
from pyspark.sql import functions as F

from recordloom.operators import priority, ranges, trends
from recordloom.functions import dates
from recordloom.functions.ranking import order_statistics, top_k


def trend(spark, values, unit="%"):
    rows = [("k", float(v), unit, f"2024-01-{n + 1:02d}", n) for n, v in enumerate(values)]
    return trends.detect_trends(spark.createDataFrame(rows, "k string, value double, unit string, date string, input_pos int"), ["k"]).first()


def test_trends(spark):
    up, down, two, one = trend(spark, [4, 6, 7]), trend(spark, [10, 7, 5]), trend(spark, [4, 7]), trend(spark, [3])
    assert (up.direction, up.point_count, up.latest, up.percent_change) == ("up", 3, 7.0, 17)
    assert (down.direction, down.percent_change) == ("down", -29)
    assert (two.direction, two.point_count, two.percent_change) == ("none", 2, 75)
    assert (one.direction, one.previous, one.percent_change) == ("none", None, None)
    assert trend(spark, [-2, -1]).percent_change == 50 and trend(spark, [0, 3]).percent_change is None
    assert trend(spark, [40, 39]).percent_change == -2  # -2.5 rounds towards plus infinity


def test_trend_ignores_other_units(spark):
    rows = [("k", 1.0, "a", "2024-01-01", 0), ("k", 9.0, "b", "2024-01-02", 1), ("k", 2.0, "a", "2024-01-03", 2), ("k", float("nan"), "b", "2024-01-04", 3), ("k", None, "b", "2024-01-05", 4)]
    row = trends.detect_trends(spark.createDataFrame(rows, "k string, value double, unit string, date string, input_pos int"), ["k"]).first()
    assert (row.unit, row.point_count, row.latest, row.previous) == ("a", 2, 2.0, 1.0)


def test_unit_conversion_and_range(spark):
    rows = [(180.0, "mg/dL", "mmol/L", 180.16, 3.9, 5.5), (5.0, "MMOL/L", "mmol/L", None, 3.9, 5.5), (5.0, "odd", "mmol/L", None, 3.9, 5.5), (1.0, None, "g", None, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "value double, unit string, range_unit string, mw double, low double, high double")
    assert [r.in_range for r in ranges.in_range(df, molecular_weight="mw").orderBy(F.col("value").desc(), "unit").collect()] == [False, True, None, None]


@pytest.mark.parametrize("sex,expected", [("male", (13.5, 17.5)), ("female", (12.0, 15.5)), ("other", None)])
def test_range_by_sex(spark, sex, expected):
    table = spark.sql(
        "select 'hb' range_id, '718-7' code, array('20509-6') alternate_codes, 'Hemoglobin' name, array('Hgb') aliases, 'g/dL' unit, cast(null as double) molecular_weight, "
        "named_struct('low', 13.5d, 'high', 17.5d) male, named_struct('low', 12.0d, 'high', 15.5d) female, cast(null as struct<low:double,high:double>) default"
    )
    groups = spark.createDataFrame([("p", "g1", "HGB!", None, None), ("p", "g2", "x", "loinc", "20509-6"), ("child", "g1", "hgb", None, None)], "patient_id string, group_id string, name string, canonical_system string, canonical_code string")
    none = spark.createDataFrame([], "patient_id string, group_id string, date string, input_pos bigint, low double, high double, unit string, ucum_code string, text string")
    codes = spark.createDataFrame([], "patient_id string, group_id string, code string, code_pos bigint")
    patients = spark.createDataFrame([("p", sex, 40), ("child", sex, 12)], "patient_id string, sex string, age int")
    got = {(r.patient_id, r.group_id): (r.low, r.high) for r in ranges.group_ranges(groups, none, codes, table, patients).collect()}
    assert got == ({} if expected is None else {("p", "g1"): expected, ("p", "g2"): expected})


def test_age(spark):
    df = spark.sql("select '2004-02-29' b, date'2025-02-28' t union all select '2004-02-29', date'2025-03-01' union all select '1800-01-01', date'2025-01-01' union all select 'junk', date'2025-01-01'")
    assert [r.a for r in df.select(dates.age_in_years(F.col("b"), F.col("t")).alias("a")).collect()] == [20, 21, None, None]


def test_scores(spark):
    cols = "base_weight double, recent_visit boolean, next_visit boolean, recent_hospital boolean, out_of_range_labs int, active_medications int"
    df = spark.createDataFrame([(0.4, False, False, False, 0, 0), (0.4, True, True, True, 5, 3), (0.0, None, None, None, 1, 2)], cols)
    a, b, c = priority.score_conditions(df).collect()
    assert round(a.total, 6) == 0.28 and a.reasons == []
    assert b.booster_score == 1.0 and [r.kind for r in b.reasons] == ["recent_encounter", "upcoming_encounter", "recent_hospitalization", "out_of_range_lab", "high_monitoring_intensity"]
    assert b.reasons[3].detail == "3 of 5 related labs flagged"
    assert round(c.total, 6) == round(0.3 * 0.35, 6)


def test_order_statistics_are_exact_and_survive_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), (F.col("id") * 7919 % 1009 / 10).alias("v"))
    got = {r.k: (r.q25, r.q75) for r in order_statistics(df, ["k"], "v", {"q25": F.floor(F.col("n") * 0.25), "q75": F.floor(F.col("n") * 0.75)}, slots=16).collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r.k, []).append(r.v)
    assert got == {k: (sorted(v)[int(len(v) * 0.25)], sorted(v)[int(len(v) * 0.75)]) for k, v in by.items()}


def test_an_outlier_does_not_fill_one_slot(spark):
    df = spark.range(20000).select(F.lit("k").alias("k"), F.when(F.col("id") == 7, 1e15).otherwise(F.col("id").cast("double")).alias("v"))
    got = order_statistics(df, ["k"], "v", {"q25": F.floor(F.col("n") * 0.25), "top": F.col("n") - 1}, slots=64).first()
    assert got.top == 1e15 and got.q25 == 5001.0
    counts = df.groupBy("k", "v").count()
    borders = counts.groupBy("k").agg(F.percentile_approx("v", F.lit([n / 64 for n in range(1, 64)]).cast("array<double>"), F.lit(1280)).alias("b"))
    slots = counts.join(borders, "k").groupBy(F.size(F.filter("b", lambda b: b < F.col("v")))).count()
    assert slots.agg(F.max("count")).first()[0] < 2 * 20000 / 64


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = top_k(df, ["k"], [F.col("v").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_impact_labels(spark):
    df = spark.createDataFrame([("s", n / 10) for n in range(9)], "s string, score double")
    got = {r.score: r.impact for r in priority.impact(df, ["s"]).collect()}
    assert got == {0.0: "low", 0.1: "low", 0.2: "low", 0.3: "moderate", 0.4: "moderate", 0.5: "moderate", 0.6: "moderate", 0.7: "high", 0.8: "high"}
