"""Classification of records: ordered patterns, nearest centroid, and the pass that combines them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import dot
from ..functions.ranking import best_row
from ..functions.text import first_text, norm_text
from ..session import saved

RESULT = "struct<label:string,domain:string,confidence:double,fallback:boolean,source:string>"

# Statements that there is no allergy, per domain, first hit wins.
NO_ALLERGY = [
    ("drug", r"\bnkda\b|\bno known drug allerg(y|ies)\b|\bno known medication allerg(y|ies)\b|\bno known medicine allerg(y|ies)\b|\bno drug allerg(y|ies)\b|\bno medication allerg(y|ies)\b"),
    ("food", r"\bno known food allerg(y|ies)\b|\bno food allerg(y|ies)\b"),
    ("environmental", r"\bno known environmental allerg(y|ies)\b|\bno environmental allerg(y|ies)\b|\bno known seasonal allerg(y|ies)\b|\bno seasonal allerg(y|ies)\b"),
    ("latex", r"\bno known latex allerg(y|ies)\b|\bno latex allerg(y|ies)\b"),
    ("generic", r"\bnka\b|\bno known allerg(y|ies)\b|\bno allerg(y|ies)\b|\bno known adverse reactions?\b"),
]
# Words that name an allergen, per domain, first hit wins.
ALLERGENS = [
    ("latex", r"\blatex\b"),
    ("drug", r"\b(penicillin|amoxicillin|ampicillin|cephalosporin|cef[a-z]+|sulfa|sulfonamide|aspirin|ibuprofen|naproxen|nsaid|codeine|morphine|opioid|drug|medication|medicine|antibiotic)\b"),
    ("food", r"\b(peanut|tree nut|nut|shellfish|shrimp|milk|egg|wheat|soy|fish|food)\b"),
    ("environmental", r"\b(pollen|dust|mold|cat|dog|grass|ragweed|seasonal|environmental)\b"),
]
# Words of vital signs and of laboratory tests.
VITAL_WORDS = r"\b(blood pressure|systolic|diastolic|heart rate|pulse|temperature|weight|height|bmi|oxygen saturation)\b"
LAB_WORDS = r"\b(hemoglobin|a1c|glucose|creatinine|cholesterol|triglyceride|vitamin|platelet|wbc|lab|laboratory)\b"
# Words of a kind of visit with its confidence, first hit wins.
VISIT_WORDS = [
    ("telehealth", 0.86, r"\b(telehealth|telemedicine|virtual|video visit|telephone)\b"),
    ("urgent_care", 0.86, r"\burgent care\b"),
    ("emergency", 0.86, r"\b(emergency|ed|emer)\b"),
    ("inpatient", 0.84, r"\b(inpatient|hospital stay|hospitalization|imp)\b"),
    ("home_health", 0.84, r"\b(home health|home visit|hh)\b"),
    ("procedure", 0.78, r"\b(surgery|surgical|procedure|operative)\b"),
    ("outpatient", 0.82, r"\b(outpatient|ambulatory|office visit|clinic|amb)\b"),
]


def concept_words() -> Column:
    """All words of a record, normalised."""
    strings = lambda name: F.coalesce(F.col(name), F.array().cast("array<string>"))
    codings = F.flatten(F.transform(F.coalesce(F.col("code_codings"), F.array().cast("array<struct<code:string,display:string>>")), lambda c: F.array(c["code"], c["display"])))
    return norm_text(F.array_join(F.concat(F.array("source_label", "grouping_text", "category", "category_code"), strings("code_texts"), codings, strings("coding_keys")), " "))


def _result(label, confidence: float, fallback: bool, source: str, domain=None) -> Column:
    d = F.lit(None).cast("string") if domain is None else F.lit(domain)
    return F.struct(F.lit(label).alias("label"), d.alias("domain"), F.lit(confidence).alias("confidence"), F.lit(fallback).alias("fallback"), F.lit(source).alias("source"))


def classify_allergy(text: Column) -> Column:
    out = F.when(text == "", _result("unknown", 0.35, True, "fallback", "unknown"))
    for domain, pattern in NO_ALLERGY:
        out = out.when(text.rlike(pattern), _result("negative_assertion", 0.92, False, "deterministic", domain))
    for domain, pattern in ALLERGENS:
        out = out.when(text.rlike(pattern), _result("specific_allergy", 0.82, False, "deterministic", domain))
    return out.otherwise(_result("specific_allergy", 0.45, True, "fallback", "unknown"))


def classify_observation(category: Column, category_code: Column, text: Column) -> Column:
    dashed = F.replace(norm_text(first_text(category_code, category)), F.lit(" "), F.lit("-"))
    return (
        F.when(dashed.isin("laboratory", "lab"), _result("labs", 1.0, False, "fhir_category"))
        .when(dashed.isin("vital-signs", "vital-sign", "vitals"), _result("vitals", 1.0, False, "fhir_category"))
        .when(dashed != "", _result("other", 0.9, False, "fhir_category"))
        .when(text.rlike(VITAL_WORDS), _result("vitals", 0.78, False, "deterministic"))
        .when(text.rlike(LAB_WORDS), _result("labs", 0.75, False, "deterministic"))
        .otherwise(_result("unknown", 0.4, True, "fallback"))
    )


def classify_visit(text: Column) -> Column:
    out = F.when(text == "", _result("unknown", 0.35, True, "fallback"))
    for label, confidence, pattern in VISIT_WORDS:
        out = out.when(text.rlike(pattern), _result(label, confidence, False, "deterministic"))
    return out.otherwise(_result("unknown", 0.4, True, "fallback"))


def name_bucket(bucket: Column, category: Column, category_code: Column) -> Column:
    """Bucket of a named record: a given one, else by words inside its category."""
    c, code = norm_text(category), norm_text(category_code)
    has = lambda col, w: F.contains(col, F.lit(w))
    return F.coalesce(
        F.nullif(bucket, F.lit("")),
        F.when(has(c, "vital") | has(code, "vital"), "vitals").when(has(c, "laboratory") | has(code, "laboratory") | has(code, "lab"), "labs").otherwise("other"),
    )


def active_domains(classified: DataFrame) -> DataFrame:
    """Distinct domains of active specific allergies per patient (``active``, ``label``, ``domain``)."""
    return classified.filter("active and label = 'specific_allergy'").select("patient_id", "domain").distinct()


def superseded_negatives(classified: DataFrame) -> DataFrame:
    """Negative assertions that an active specific allergy of the patient contradicts."""
    # Both sides read the classes, so records are classified once.
    told = saved(classified.filter("label = 'negative_assertion' or (active and label = 'specific_allergy')"))
    # Any active allergy of a patient also contradicts that there is none.
    domains = active_domains(told).select("patient_id", F.explode(F.array("domain", F.lit("generic"))).alias("domain")).distinct()
    negative = told.filter("label = 'negative_assertion' and domain <> 'unknown'")
    return negative.join(domains, ["patient_id", "domain"], "left_semi").select(*classified.columns)


def centroids(vectors: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Unit-length mean vector per class; a zero mean stays as it is.

    The mean is a built-in vector aggregate: one partial sum per class and task, no row per dimension.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from ..functions.geometry import unit_vector

    v = vectors.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    means = v.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m")).withColumn("_a", vector_to_array("_m"))
    return means.select(*keys, unit_vector(F.col("_a")).alias("centroid"))


def _score_classes(vector: Column, classes: Column) -> Column:
    return F.transform(classes, lambda c: F.struct(dot(vector, c["centroid"]).alias("score"), c["class_name"].alias("class_name")))


def _best(scores: Column) -> Column:
    """Highest score; the first class name in binary order on a tie."""
    return F.aggregate(
        scores,
        F.lit(None).cast("struct<score:double,class_name:string>"),
        lambda acc, s: F.when(acc.isNull() | (s["score"] > acc["score"]) | ((s["score"] == acc["score"]) & (s["class_name"] < acc["class_name"])), s).otherwise(acc),
    )


def nearest_class(vectors: DataFrame, classes: DataFrame, keys: list[str], vector: str = "embedding", block_rows: int = 512) -> DataFrame:
    """Class with the largest dot product for every vector.

    ``classes(class_name, centroid)`` of one task are cut into blocks of about ``block_rows``. A vector meets each block once,
    and keeps one partial maximum of it.
    """
    listed = classes.select(F.struct(F.col("class_name").cast("string").alias("class_name"), F.col("centroid")).alias("_c"))
    n_blocks = max(1, -(-classes.count() // block_rows))
    blocks = listed.withColumn("_block", F.pmod(F.xxhash64("_c.class_name"), F.lit(n_blocks))).groupBy("_block").agg(F.collect_list("_c").alias("_all"))
    spread = vectors.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
    part = spread.join(blocks, "_block").withColumn("_b", _best(_score_classes(F.col(vector), F.col("_all"))))
    top = part.groupBy(*keys).agg(F.min(F.struct((-F.col("_b.score")).alias("s"), F.col("_b.class_name").alias("c"))).alias("_t"))
    return top.select(*keys, F.col("_t.c").alias("class_name"), (-F.col("_t.s")).alias("confidence"))


def accuracy(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of correct labels and mean confidence of the correct ones (``label``, ``class_name``, ``confidence``)."""
    hit = F.col("label") == F.col("class_name")
    return predictions.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("accuracy"), F.avg(F.when(hit, F.col("confidence"))).alias("mean_confidence")
    )


# Rank of the model of a classification entry, lower is preferred.
MODEL_RANKS = {"fhir_category": 0, "local_model": 1, "deterministic": 2}


def model_rank(model: Column) -> Column:
    out = F.lit(3)
    for name, rank in MODEL_RANKS.items():
        out = F.when(model == name, rank).otherwise(out)
    return out


def preferred_entries(cache: DataFrame, versions: dict[str, int], keys: list[str] | None = None) -> DataFrame:
    """Best current entry per (transform, record): model rank, then the newest."""
    current = F.lit(False)
    for transform, version in versions.items():
        current = current | ((F.col("transform") == transform) & (F.col("transform_version") == version))
    k = [*(keys or []), "transform", "compact_id"]
    return best_row(cache.filter(current), k, [model_rank(F.col("model")), F.col("updated_at").desc(), F.col("model")])


def map_class_name(transform: Column, class_name: Column) -> Column:
    """Class names of the embedding tasks in the vocabulary of the records."""
    return (
        F.when(transform == "Observation.classifyCategory", F.when(class_name == "lab", "labs").when(class_name == "vital", "vitals").otherwise("other"))
        .when(transform == "AllergyIntolerance.classifyAllergy", F.when(class_name == "medication", "drug").otherwise(class_name))
        .otherwise(class_name)
    )


def classification_pass(records: DataFrame, cache: DataFrame, predictions: DataFrame, versions: dict[str, int], now_ms: int) -> DataFrame:
    """New cache entries for ``records(transform, compact_id, resource_type, deterministic RESULT)``.

    Records whose preferred entry is an embedding, or whose pattern result is authoritative, are left alone (the
    latter is written when there is no entry yet). The rest take the embedding prediction, else the pattern result.
    """
    have = preferred_entries(cache, versions).select("transform", "compact_id", F.col("model").alias("_have"))
    rows = records.join(have, ["transform", "compact_id"], "left")
    embedded = F.coalesce(F.col("_have") == "embedding", F.lit(False))
    settled = F.coalesce(F.col("deterministic.source") == "fhir_category", F.lit(False)) & ~embedded
    first_seen = rows.filter(settled & F.col("_have").isNull()).select("transform", "compact_id", "resource_type", F.col("deterministic.source").alias("model"), F.col("deterministic").alias("result"))
    open_rows = rows.filter(~embedded & ~settled).join(predictions.select("transform", "compact_id", "class_name", "confidence"), ["transform", "compact_id"], "left")
    predicted = F.col("class_name").isNotNull()
    name = map_class_name(F.col("transform"), F.col("class_name"))
    allergy = F.col("transform") == "AllergyIntolerance.classifyAllergy"
    made = F.struct(
        F.when(allergy, "specific_allergy").otherwise(name).alias("label"), F.when(allergy, name).alias("domain"),
        F.col("confidence").cast("double").alias("confidence"), F.lit(False).alias("fallback"), F.lit("embedding").alias("source"),
    )
    rest = open_rows.filter(predicted | F.col("deterministic").isNotNull()).select(
        "transform", "compact_id", "resource_type",
        F.when(predicted, "embedding").otherwise(F.col("deterministic.source")).alias("model"),
        F.when(predicted, made).otherwise(F.col("deterministic")).cast(RESULT).alias("result"),
    )
    version = F.lit(None).cast("int")
    for transform, v in versions.items():
        version = F.when(F.col("transform") == transform, v).otherwise(version)
    out = first_seen.withColumn("result", F.col("result").cast(RESULT)).unionByName(rest)
    return out.withColumns({"transform_version": version, "updated_at": F.lit(now_ms).cast("bigint")})
