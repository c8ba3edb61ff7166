"""What matters most: scores, quartile labels, top items per section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import MS_PER_DAY, millis, within_days, within_next_days
from ..functions.ranking import order_statistics, top_k

# Weights, windows in days and boosters of the score.
BASE_WEIGHT, BOOSTER_WEIGHT, BOOSTER_CAP = 0.7, 0.3, 1.0
RECENT_VISIT_DAYS, NEXT_VISIT_DAYS, HOSPITAL_DAYS, LAB_DAYS, DISPLAY_RECENT_DAYS = 90, 30, 30, 180, 90
RECENT_VISIT, NEXT_VISIT, HOSPITAL, OUT_OF_RANGE, TWO_MEDICATIONS, THREE_MEDICATIONS = 0.20, 0.30, 0.50, 0.15, 0.20, 0.30
COUNTED_LABS = 3
HOSPITAL_CLASSES = ("inpatient", "emergency")
SECTION_SIZE = 8


def visit_flags(visits: DataFrame, keys: list[str], now_ms: int) -> DataFrame:
    """Per subject: a recent visit, a coming visit, a recent hospital stay; from ``visits(keys, period_start, visit_class)``."""
    start = F.col("period_start")
    in_hospital = F.coalesce(F.col("visit_class").isin(*HOSPITAL_CLASSES), F.lit(False))
    return visits.groupBy(*keys).agg(
        F.bool_or(within_days(start, RECENT_VISIT_DAYS, now_ms)).alias("recent_visit"),
        F.bool_or(within_next_days(start, NEXT_VISIT_DAYS, now_ms)).alias("next_visit"),
        F.bool_or(within_days(start, HOSPITAL_DAYS, now_ms) & in_hospital).alias("recent_hospital"),
    )


def _reason(kind, contribution: Column, cond: Column, detail: Column | None = None) -> Column:
    words = (detail if detail is not None else F.lit(None)).cast("string")
    name = kind if isinstance(kind, Column) else F.lit(kind)
    return F.when(F.coalesce(cond, F.lit(False)), F.struct(name.alias("kind"), contribution.cast("double").alias("contribution"), words.alias("detail")))


def _medications(n: Column, words: str) -> Column:
    return _reason(
        F.when(n >= 3, "high_monitoring_intensity").otherwise("multiple_related_meds"),
        F.when(n >= 3, THREE_MEDICATIONS).otherwise(TWO_MEDICATIONS), n >= 2, F.concat(n.cast("string"), F.lit(words)),
    )


def compose(df: DataFrame, base: Column, reasons: list[Column]) -> DataFrame:
    """Add ``total, base, booster_score, reasons``."""
    listed = F.array_compact(F.array(*reasons))
    boost = F.aggregate(listed, F.lit(0.0), lambda s, r: s + r["contribution"])
    with_parts = df.withColumns({"base": base.cast("double"), "reasons": listed}).withColumn("booster_score", F.greatest(F.lit(0.0), F.least(F.lit(BOOSTER_CAP), boost)))
    return with_parts.withColumn("total", F.lit(BASE_WEIGHT) * F.col("base") + F.lit(BOOSTER_WEIGHT) * F.col("booster_score"))


def score_conditions(df: DataFrame) -> DataFrame:
    """``df(base_weight, recent_visit, next_visit, recent_hospital, out_of_range_labs, active_medications)``."""
    n, counted = F.col("out_of_range_labs"), F.least("out_of_range_labs", F.lit(COUNTED_LABS))
    return compose(
        df, F.col("base_weight"),
        [
            _reason("recent_encounter", F.lit(RECENT_VISIT), F.col("recent_visit")),
            _reason("upcoming_encounter", F.lit(NEXT_VISIT), F.col("next_visit")),
            _reason("recent_hospitalization", F.lit(HOSPITAL), F.col("recent_hospital")),
            _reason("out_of_range_lab", counted * F.lit(OUT_OF_RANGE), n > 0, F.concat(counted.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" related labs flagged"))),
            _medications(F.col("active_medications"), " active related medications"),
        ],
    )


def score_labs(df: DataFrame) -> DataFrame:
    """``df(base_weight, out_of_range, related_medications)``."""
    n = F.col("related_medications")
    meds = _reason("multiple_related_meds", F.when(n >= 3, THREE_MEDICATIONS).otherwise(TWO_MEDICATIONS), n >= 2, F.concat(n.cast("string"), F.lit(" medications monitor this lab")))
    flag = _reason("out_of_range_lab", F.lit(OUT_OF_RANGE), F.col("out_of_range"), F.lit("Most recent value outside reference range"))
    return compose(df, F.col("base_weight"), [flag, meds])


def score_medications(df: DataFrame) -> DataFrame:
    return compose(df, F.col("base_weight"), [_reason("recent_encounter", F.lit(RECENT_VISIT), F.col("recent_visit")), _reason("upcoming_encounter", F.lit(NEXT_VISIT), F.col("next_visit"))])


def score_encounters(df: DataFrame) -> DataFrame:
    return compose(df, F.col("base_weight"), [_reason("recent_hospitalization", F.lit(HOSPITAL), F.col("visit_class").isin(*HOSPITAL_CLASSES))])


def inherited_weights(group_edges: DataFrame, condition_weights: DataFrame) -> DataFrame:
    """Largest weight among the conditions that own a lab group; only positive ones count."""
    owned = group_edges.filter("relationship <> 'none' and source_type = 'Observation' and target_type = 'Condition'")
    w = condition_weights.select("patient_id", F.col("group_key").alias("target_group"), "weight")
    return owned.join(w, ["patient_id", "target_group"]).groupBy("patient_id", F.col("source_group").alias("group_key")).agg(F.max("weight").alias("inherited_weight")).filter("inherited_weight > 0")


def display_scores(groups: DataFrame) -> DataFrame:
    """Light score of a group: ``groups(section, weight, inherited_weight, out_of_range, confidence, has_recent)``."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    flag = lambda c, v: F.when(F.coalesce(F.col(c), F.lit(False)), v).otherwise(0.0)
    tier = (
        F.when(F.col("section") == "condition", F.lit(0.7) * zero("weight") + F.lit(0.10))
        .when(F.col("section") == "observation", F.lit(0.3) * zero("inherited_weight") + flag("out_of_range", 0.10))
        .otherwise(0.05)
    )
    return groups.withColumn("score", tier + F.lit(0.05) * F.col("confidence") + flag("has_recent", 0.03))


def has_recent_value(observations: DataFrame, keys: list[str], now_ms: int, days: int = DISPLAY_RECENT_DAYS) -> DataFrame:
    """Any member younger than ``days`` (dates in the future count as young)."""
    return observations.groupBy(*keys).agg(F.bool_or(F.coalesce(F.lit(now_ms) - millis(F.col("date")) < days * MS_PER_DAY, F.lit(False))).alias("has_recent"))


def quartiles(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Positive scores at positions floor(n/4) and floor(3n/4) of each section, exact and without sorting a section."""
    picks = {"q25": F.floor(F.col("n") * 0.25), "q75": F.floor(F.col("n") * 0.75)}
    return order_statistics(scored.filter(F.col(score) > 0).select(*keys, score), keys, score, picks)


def impact(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    rows = scored.join(quartiles(scored, keys, score), keys, "left")
    s = F.col(score)
    label = F.when(F.col("q25").isNull() | (s <= 0), "low").when(s >= F.col("q75"), "high").when(s >= F.col("q25"), "moderate").otherwise("low")
    return rows.withColumn("impact", label)


def top_items(scored: DataFrame, keys: list[str], tie: str, score: str = "score", size: int = SECTION_SIZE) -> DataFrame:
    """The best positive items of a section and how many stay hidden."""
    best = top_k(scored.filter(F.col(score) > 0), keys, [F.col(score).desc(), F.col(tie)], size, "position")
    totals = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col(score) > 0).alias("_pos"))
    shown = totals.withColumn("hidden_count", F.col("_all") - F.least("_pos", F.lit(size))).drop("_all", "_pos")
    return best.join(shown, keys)


def overview(scored: DataFrame, claims: DataFrame, tie: str, score: str = "score", size: int = SECTION_SIZE) -> DataFrame:
    """The best positive items of a patient across all sections, and how many stay hidden.

    Observations and medications in ``claims(patient_id, group_key)`` are shown beside their condition and are left out here.
    """
    inline = F.col("resource_type").isin("Observation", "MedicationRequest")
    taken = claims.select("patient_id", "group_key").distinct().withColumn("_taken", F.lit(True))
    free = scored.join(taken, ["patient_id", "group_key"], "left").filter(~(inline & F.col("_taken").isNotNull())).drop("_taken")
    return top_items(free, ["patient_id"], tie, score, size)
