"""Checked queries for text search, classification and the provider directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry
from ..functions import text as T
from ..operators import bm25, classify, directory, grouping
from ..session import once
from .registry import Tables, pick, register, sql_pick, text

STOP_SQL = "[" + ",".join(f"'{w}'" for w in bm25.STOP_WORDS) + "]"
STEM_SQL = bm25.suffix_pattern()


def token_sql(col: str) -> str:
    return (
        f"list_transform(list_filter(regexp_extract_all(lower({col}), '[a-z]{{3,}}'), lambda w: NOT list_contains({STOP_SQL}, w)), "
        f"lambda w: regexp_replace(w, '{STEM_SQL}', '\\1'))"
    )


@register("tokens", f"WITH d AS (SELECT doc_id, {token_sql('text')} AS t FROM documents) SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM d")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bm25.tokens(F.col("text"))
    return Tables(spark, sf_dir).heavy("documents").select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


def corpus(t: Tables) -> DataFrame:
    """Documents as names of two categories."""
    k = F.col("doc_id")
    return t.heavy("documents").select(
        pick(k % 2, "condition", "lab").alias("category"), k.alias("rid"), "text", F.concat(F.lit("Doc "), text(k)).alias("name"), F.when(k % 5 == 0, F.concat(F.lit("Friendly "), text(k % 50))).alias("friendly_name"),
        F.when(k % 7 != 0, text(k)).alias("code"), F.lit("snomed").alias("system"),
    )


INDEX_SQL = f"""
tok AS (SELECT CASE doc_id % 2 WHEN 0 THEN 'condition' ELSE 'lab' END AS category, doc_id AS rid, {token_sql('text')} AS t FROM documents),
docs AS (SELECT category, rid, len(t) AS dl FROM tok),
st AS (SELECT category, count(*) AS n, avg(dl) AS av FROM docs GROUP BY ALL),
tf AS (SELECT category, rid, term, count(*) AS tf FROM (SELECT category, rid, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT category, term, count(*) AS df FROM tf GROUP BY ALL),
post AS (
  SELECT tf.category, tf.term, tf.rid, tf.tf, ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) AS idf, ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * (tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * docs.dl / st.av))) AS impact
  FROM tf JOIN df ON df.category = tf.category AND df.term = tf.term JOIN docs ON docs.rid = tf.rid JOIN st ON st.category = tf.category)
"""


@register("index_terms", f"WITH {INDEX_SQL} SELECT category, term, count(*) AS df, round(any_value(idf), 6) AS idf, round(sum(impact), 4) AS impact FROM post GROUP BY ALL")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = bm25.build_index(corpus(Tables(spark, sf_dir)).select("category", "rid", "text"))
    sums = index["postings"].groupBy("category", "term").agg(F.round(F.sum("impact"), 4).alias("impact"))
    return index["terms"].join(sums, ["category", "term"]).select("category", "term", "df", F.round("idf", 6).alias("idf"), "impact")


@register("index_stats", f"WITH {INDEX_SQL} SELECT category, n AS n_docs, round(av, 6) AS avg_length FROM st")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = bm25.build_index(corpus(Tables(spark, sf_dir)).select("category", "rid", "text"))["stats"]
    return stats.select("category", "n_docs", F.round("avg_length", 6).alias("avg_length"))


SEARCH_SQL = f"""
{INDEX_SQL},
q AS (SELECT CASE item_id % 2 WHEN 0 THEN 'condition' ELSE 'lab' END AS category, item_id AS qid, unnest({token_sql('text')}) AS term FROM benchmark),
sc AS (SELECT q.category, q.qid, post.rid, sum(post.impact) AS score FROM q JOIN post ON post.category = q.category AND post.term = q.term GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY category, qid ORDER BY round(score, 9) DESC, rid) AS rank FROM sc)
"""


def ranked(t: Tables, k: int, salt: int = 4) -> DataFrame:
    index = bm25.build_index(corpus(t).select("category", "rid", "text"), salt)
    queries = t.benchmark.select(pick(F.col("item_id") % 2, "condition", "lab").alias("category"), F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return bm25.search(queries, index["postings"], k, salt)


@register("text_search", f"WITH {SEARCH_SQL} SELECT category, qid, rid, CAST(rank AS INTEGER) AS rank, floor(score * 100 + 0.5) / 100 AS score FROM rk WHERE rank <= 5")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(Tables(spark, sf_dir), 5)


@register(
    "distinct_candidates",
    f"""
WITH {SEARCH_SQL}, n AS (SELECT category, qid, rid, rank, CASE WHEN rid % 5 = 0 THEN 'Friendly ' || (rid % 50) ELSE 'Doc ' || rid END AS name FROM rk WHERE rank <= 20)
SELECT category, qid, rid, CAST(rank AS INTEGER) AS rank FROM n QUALIFY row_number() OVER (PARTITION BY category, qid, name ORDER BY rank) = 1
""",
)
def distinct_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return bm25.distinct_names(ranked(t, 20), corpus(t)).select("category", "qid", "rid", "rank")


@register(
    "search_names",
    f"""
WITH {INDEX_SQL},
c AS (SELECT conv_id, turn, text, CASE (conv_id + turn) % 3 WHEN 0 THEN 'condition' WHEN 1 THEN 'lab' END AS category FROM conversations),
u AS (SELECT DISTINCT category, text FROM c WHERE category IS NOT NULL),
q AS (SELECT category, text, unnest({token_sql('text')}) AS term FROM u),
sc AS (SELECT q.category, q.text, post.rid, sum(post.impact) AS score FROM q JOIN post ON post.category = q.category AND post.term = q.term GROUP BY ALL),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY category, text ORDER BY round(score, 9) DESC, rid) = 1),
r AS (SELECT *, floor(score * 100 + 0.5) / 100 AS rounded FROM b)
SELECT conv_id, turn, CASE WHEN rid % 5 = 0 THEN 'Friendly ' || (rid % 50) ELSE 'Doc ' || rid END AS name, CAST(rid AS VARCHAR) AS code, rounded AS score, round(least(rounded / 20, 0.85), 6) AS confidence
FROM c JOIN r ON r.category = c.category AND r.text = c.text WHERE rounded >= 5 AND rid % 7 <> 0
""",
)
def search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    names = corpus(t)
    index = bm25.build_index(names.select("category", "rid", "text"))
    rows = t.conversations.select(
        "conv_id", "turn", pick((F.col("conv_id") + F.col("turn")) % 3, "Condition", "Observation", "Encounter").alias("resource_type"), F.lit("").alias("source_label"),
        F.array("text").alias("code_texts"), F.lit(None).cast("array<struct<code:string,display:string>>").alias("code_codings"),
    )
    out = bm25.name_records(rows, index, names, ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.col("friendly").alias("name"), "code", "score", F.round("confidence", 6).alias("confidence"))


# --- pattern classification over documents: the first words of a text get one clinical phrase

ALLERGY_WORDS = ("No known allergies", "NKDA", "Peanut", "latex gloves", "no food allergy", "cefazolin", "ragweed", "stone", "no known adverse reaction", "seasonal", "no known latex allergies", "tree nut mix")
def phrase_rows(t: Tables, words: tuple) -> DataFrame:
    """Every document's own text; most have one clinical phrase behind it."""
    k = F.col("doc_id")
    phrase = F.when(k % 50 != 49, pick(k % len(words), *words))
    return t.heavy("documents").select("doc_id", "source", T.norm_text(F.concat_ws(" ", "text", phrase)).alias("words"))


def _words_sql(words: tuple) -> str:
    phrase = f"CASE WHEN doc_id % 50 <> 49 THEN {sql_pick(f'doc_id % {len(words)}', *words)} END"
    return f"d AS (SELECT doc_id, trim(regexp_replace(lower(concat_ws(' ', text, {phrase})), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)"


def _rules_sql(rules: list[tuple[str, str]], otherwise: str, empty: str) -> str:
    """CASE over patterns in their order: what a pattern gives, what all others give, and what an empty text gives."""
    return f"CASE WHEN t = '' THEN {empty} " + " ".join(f"WHEN regexp_matches(t, '{pattern}') THEN {value}" for pattern, value in rules) + f" ELSE {otherwise} END"


def _allergy_sql() -> str:
    denials, named = classify.NO_ALLERGY, classify.ALLERGENS
    label = _rules_sql([(p, "'negative_assertion'") for _, p in denials] + [(p, "'specific_allergy'") for _, p in named], "'specific_allergy'", "'unknown'")
    domain = _rules_sql([(p, f"'{d}'") for d, p in (*denials, *named)], "'unknown'", "'unknown'")
    confidence = _rules_sql([(p, "0.92") for _, p in denials] + [(p, "0.82") for _, p in named], "0.45", "0.35")
    return f"{_words_sql(ALLERGY_WORDS)}, al AS (SELECT doc_id, {label} AS label, {domain} AS domain, CAST({confidence} AS DOUBLE) AS confidence FROM d)"


@register("allergy_classes", f"WITH {_allergy_sql()} SELECT doc_id, label, domain, confidence, confidence < 0.5 AS fallback FROM al")
def allergy_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phrase_rows(Tables(spark, sf_dir), ALLERGY_WORDS)
    return rows.select("doc_id", classify.classify_allergy(F.col("words")).alias("_c")).select("doc_id", "_c.label", "_c.domain", "_c.confidence", "_c.fallback")


VISIT_PHRASES = ("Video visit", "urgent care", "EMER", "hospital stay", "home visit", "Surgical day", "AMB", "meeting", "ED follow-up", "Telephone emergency")
VISIT_CLASS_SQL = r"""CASE WHEN t = '' THEN 'unknown' WHEN regexp_matches(t, '\b(telehealth|telemedicine|virtual|video visit|telephone)\b') THEN 'telehealth' WHEN regexp_matches(t, '\burgent care\b') THEN 'urgent_care'
  WHEN regexp_matches(t, '\b(emergency|ed|emer)\b') THEN 'emergency' WHEN regexp_matches(t, '\b(inpatient|hospital stay|hospitalization|imp)\b') THEN 'inpatient' WHEN regexp_matches(t, '\b(home health|home visit|hh)\b') THEN 'home_health'
  WHEN regexp_matches(t, '\b(surgery|surgical|procedure|operative)\b') THEN 'procedure' WHEN regexp_matches(t, '\b(outpatient|ambulatory|office visit|clinic|amb)\b') THEN 'outpatient' ELSE 'unknown' END"""
VISIT_TEXTS_SQL = "d AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)"


@register("visit_classes", f"WITH {_words_sql(VISIT_PHRASES)} SELECT doc_id, {VISIT_CLASS_SQL} AS label FROM d")
def visit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phrase_rows(Tables(spark, sf_dir), VISIT_PHRASES)
    return rows.select("doc_id", classify.classify_visit(F.col("words"))["label"].alias("label"))


@register(
    "visit_class_counts",
    f"WITH {VISIT_TEXTS_SQL} SELECT source, coalesce(CASE WHEN doc_id % 9 = 0 THEN 'inpatient' END, {VISIT_CLASS_SQL}) AS visit_class, count(*) AS n FROM d GROUP BY ALL",
)
def visit_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = Tables(spark, sf_dir).heavy("documents").select("source", T.norm_text(F.col("text")).alias("words"), F.when(F.col("doc_id") % 9 == 0, "inpatient").alias("chosen_class"))
    return grouping.visit_class_counts(visits, ["source"])


@register("visit_words_in_texts", f"WITH {VISIT_TEXTS_SQL} SELECT doc_id, {VISIT_CLASS_SQL} AS label FROM d")
def visit_words_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).heavy("documents").select("doc_id", classify.classify_visit(T.norm_text(F.col("text")))["label"].alias("label"))


OBS_CATEGORIES = ("laboratory", "Vital Signs", "exam", None, "LAB", "", "vitals")
OBS_WORDS = ("Heart Rate", "Hemoglobin A1c", "Mood", "BMI", "Vitamin D", "walk", "Glucose", "lab panel")
_by_words = lambda vitals, labs, other: _rules_sql([(classify.VITAL_WORDS, vitals), (classify.LAB_WORDS, labs)], other, other)


@register(
    "observation_classes",
    f"""
WITH {_words_sql(OBS_WORDS)}, x AS (SELECT *, lower({sql_pick('doc_id % 7', *OBS_CATEGORIES)}) AS c FROM d)
SELECT doc_id, CASE WHEN c IN ('laboratory', 'lab') THEN 'labs' WHEN c IN ('vital signs', 'vitals') THEN 'vitals' WHEN c <> '' THEN 'other' ELSE {_by_words("'vitals'", "'labs'", "'unknown'")} END AS label,
  CAST(CASE WHEN c IN ('laboratory', 'lab', 'vital signs', 'vitals') THEN 1.0 WHEN c <> '' THEN 0.9 ELSE {_by_words("0.78", "0.75", "0.4")} END AS DOUBLE) AS confidence FROM x
""",
)
def observation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classify.classify_observation(pick(F.col("doc_id") % 7, *OBS_CATEGORIES), F.lit(None).cast("string"), F.col("words"))
    return phrase_rows(Tables(spark, sf_dir), OBS_WORDS).select("doc_id", c.alias("_c")).select("doc_id", "_c.label", "_c.confidence")


@register("name_buckets", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'vitals' WHEN 1 THEN 'labs' WHEN 2 THEN 'other' ELSE 'given' END AS bucket FROM documents")
def name_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    bucket = classify.name_bucket(F.when(k % 4 == 3, "given").otherwise(""), pick(k % 4, "Vital-Signs", "x", "exam", "lab"), pick(k % 4, None, "my-lab", None, None))
    return Tables(spark, sf_dir).documents.select("doc_id", bucket.alias("bucket"))


@register(
    "superseded_negatives",
    f"""
WITH {_allergy_sql()}, x AS (SELECT *, doc_id % 40 AS p, doc_id % 5 <> 0 AS active FROM al),
s AS (SELECT DISTINCT p, domain FROM x WHERE active AND label = 'specific_allergy')
SELECT doc_id FROM x WHERE label = 'negative_assertion' AND (domain = 'generic' AND p IN (SELECT p FROM s) OR domain <> 'generic' AND (p, domain) IN (SELECT (p, domain) FROM s))
""",
)
def superseded_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.superseded_negatives(classified_allergies(Tables(spark, sf_dir))).select("doc_id")


def classified_allergies(t: Tables) -> DataFrame:
    """Documents as allergy notes of 40 patients; every fifth is not active."""
    k = F.col("doc_id")
    rows = phrase_rows(t, ALLERGY_WORDS).select("doc_id", (k % 40).alias("patient_id"), (k % 5 != 0).alias("active"), "words")
    return once(rows, "_c", classify.classify_allergy(F.col("words"))).select("doc_id", "patient_id", "active", "_c.*")


@register("active_allergy_domains", f"WITH {_allergy_sql()} SELECT DISTINCT doc_id % 40 AS patient_id, domain FROM al WHERE doc_id % 5 <> 0 AND label = 'specific_allergy'")
def active_allergy_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.active_domains(classified_allergies(Tables(spark, sf_dir)))


VERSIONS = {"AllergyIntolerance.classifyAllergy": 1, "Encounter.classifyClass": 2}
MODEL_CYCLE = ("embedding", "deterministic", "fhir_category", "local_model", "other")


def class_cache(t: Tables) -> DataFrame:
    k = F.col("event_id")
    return t.events.select(
        pick(k % 2, *VERSIONS).alias("transform"), (k % 2 + 1 + F.when(k % 13 == 0, 1).otherwise(0)).cast("int").alias("transform_version"), F.concat_ws("-", text("user_id"), "event_type").alias("compact_id"),
        pick(F.col("value").cast("int") % 5, *MODEL_CYCLE).alias("model"), k.alias("updated_at"),
    )


PREFERRED_SQL = f"""
c AS (SELECT event_id % 2 AS tr, event_id % 13 = 0 AS stale, user_id || '-' || event_type AS compact_id, {sql_pick('CAST(trunc(value) AS BIGINT) % 5', *MODEL_CYCLE)} AS model, event_id AS updated_at FROM events),
p AS (SELECT {sql_pick('tr', *VERSIONS)} AS transform, compact_id, model, updated_at FROM c WHERE NOT stale
      QUALIFY row_number() OVER (PARTITION BY tr, compact_id ORDER BY CASE model WHEN 'fhir_category' THEN 0 WHEN 'local_model' THEN 1 WHEN 'deterministic' THEN 2 ELSE 3 END, updated_at DESC) = 1)
"""


@register("preferred_entries", f"WITH {PREFERRED_SQL} SELECT * FROM p")
def preferred_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.preferred_entries(class_cache(Tables(spark, sf_dir)), VERSIONS).select("transform", "compact_id", "model", "updated_at")


@register(
    "classification_pass",
    f"""
WITH {PREFERRED_SQL},
r AS (SELECT DISTINCT user_id || '-' || event_type AS compact_id, user_id, unnest(['AllergyIntolerance.classifyAllergy', 'Encounter.classifyClass']) AS transform FROM events),
j AS (SELECT r.*, p.model, user_id % 4 = 0 AS fixed, user_id % 3 <> 0 AS predicted FROM r LEFT JOIN p ON p.transform = r.transform AND p.compact_id = r.compact_id)
SELECT transform, compact_id, CASE WHEN fixed THEN 'fhir_category' WHEN predicted THEN 'embedding' ELSE 'deterministic' END AS new_model,
  CASE WHEN fixed OR NOT predicted THEN 'det' WHEN transform LIKE 'Allergy%' THEN 'specific_allergy' ELSE 'medication' END AS label,
  CASE WHEN NOT fixed AND predicted AND transform LIKE 'Allergy%' THEN 'drug' END AS domain
FROM j WHERE (fixed AND model IS NULL) OR (NOT fixed AND coalesce(model, '') <> 'embedding') OR (fixed AND false)
""",
)
def classification_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    key = F.concat_ws("-", text("user_id"), "event_type").alias("compact_id")
    transforms = F.explode(F.array(*[F.lit(v) for v in VERSIONS])).alias("transform")
    base = t.events.select(key, "user_id").distinct().select("compact_id", "user_id", transforms)
    det = F.struct(F.lit("det").alias("label"), F.lit(None).cast("string").alias("domain"), F.lit(0.5).alias("confidence"), F.lit(False).alias("fallback"), F.when(F.col("user_id") % 4 == 0, "fhir_category").otherwise("deterministic").alias("source"))
    rows = base.select("transform", "compact_id", F.lit("x").alias("resource_type"), det.alias("deterministic"))
    predictions = base.filter("user_id % 3 <> 0").select("transform", "compact_id", F.lit("medication").alias("class_name"), F.lit(0.7).alias("confidence"))
    out = classify.classification_pass(rows, class_cache(t), predictions, VERSIONS, 1)
    return out.select("transform", "compact_id", F.col("model").alias("new_model"), "result.label", "result.domain")


# --- vectors

CENTROID_SQL = """
x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
m AS (SELECT label, pos, avg(v) AS v FROM x GROUP BY ALL),
n AS (SELECT label, sqrt(sum(v * v)) AS norm FROM m GROUP BY ALL),
c AS (SELECT m.label, m.pos, m.v / n.norm AS v FROM m JOIN n ON n.label = m.label)
"""


@register("class_centroids", f"WITH {CENTROID_SQL} SELECT label, pos::INTEGER AS pos, round(v, 6) AS v FROM c")
def class_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify.centroids(Tables(spark, sf_dir).embeddings, ["label"])
    rows = out.select("label", F.posexplode("centroid").alias("pos", "v"))
    return rows.select("label", (F.col("pos") + 1).alias("pos"), F.round("v", 6).alias("v"))


NEAREST_SQL = f"""
{CENTROID_SQL},
e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
s AS (SELECT e.vec_id, e.label, c.label AS cls, sum(e.v * c.v) AS score FROM e JOIN c ON c.pos = e.pos GROUP BY ALL),
b AS (SELECT vec_id, label, CAST(cls AS VARCHAR) AS class_name, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, CAST(cls AS VARCHAR)) = 1)
"""


def nearest(t: Tables, block_rows: int = 512) -> DataFrame:
    classes = classify.centroids(t.embeddings, ["label"]).select(F.col("label").alias("class_name"), "centroid")
    return classify.nearest_class(t.embeddings, classes, ["vec_id", "label"], block_rows=block_rows)


@register("nearest_centroid", f"WITH {NEAREST_SQL} SELECT vec_id, class_name, round(score, 6) AS confidence FROM b")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(Tables(spark, sf_dir)).select("vec_id", "class_name", F.round("confidence", 6).alias("confidence"))


@register("nearest_centroid_in_blocks", f"WITH {NEAREST_SQL} SELECT vec_id, class_name, round(score, 6) AS confidence FROM b")
def nearest_centroid_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(Tables(spark, sf_dir), block_rows=4).select("vec_id", "class_name", F.round("confidence", 6).alias("confidence"))


@register(
    "centroid_accuracy",
    f"WITH {NEAREST_SQL} SELECT label, count(*) AS n, round(avg(CASE WHEN CAST(label AS VARCHAR) = class_name THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy, round(avg(CASE WHEN CAST(label AS VARCHAR) = class_name THEN score END), 6) AS mean_confidence FROM b GROUP BY ALL",
)
def centroid_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nearest(Tables(spark, sf_dir)).withColumn("label", text("label"))
    out = classify.accuracy(rows, ["label"])
    return out.select(F.col("label").cast("int").alias("label"), "n", F.round("accuracy", 6).alias("accuracy"), F.round("mean_confidence", 6).alias("mean_confidence"))


@register(
    "label_accuracy",
    """
WITH p AS (SELECT l.quality, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS cls, n_chars / 1000.0 AS conf FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT count(*) AS n, round(avg(CASE WHEN quality = cls THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy, round(avg(CASE WHEN quality = cls THEN conf END), 6)::DOUBLE AS mean_confidence FROM p
""",
)
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("label"), F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("class_name"), (F.col("n_chars") / 1000.0).alias("confidence"))
    out = classify.accuracy(rows)
    return out.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("mean_confidence", 6).alias("mean_confidence"))


# --- option search and tokens


@register("token_filter", "SELECT doc_id FROM documents WHERE contains(lower(text), 'an') AND contains(lower(text), 'the') AND contains(lower(text), 'ou')")
def token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.filter(T.tokens_all_match(F.lower("text"), " The AN ou ")).select("doc_id")


@register(
    "option_search",
    """
WITH o AS (SELECT p_partkey, p_name, CAST(p_partkey AS VARCHAR) AS code, lower(p_brand || ' ' || p_name) AS brand, regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', ' ', 'g') AS tech FROM part),
s AS (SELECT *, CASE WHEN starts_with(p_name, 'large ring') THEN 0.0 ELSE 20.0 END + CASE WHEN starts_with(tech, 'large ring') THEN 2.0 ELSE 0.0 END + least(length(tech), 240) / 1000 AS score
  FROM o WHERE contains(p_name || ' ' || tech || ' ' || code, 'large') AND contains(p_name || ' ' || tech || ' ' || code, 'ring'))
SELECT p_partkey, p_name AS name, round(score, 4)::DOUBLE AS score FROM s ORDER BY score, p_name, code LIMIT 25
""",
)
def option_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = Tables(spark, sf_dir).part.select("p_partkey", F.col("p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_name").alias("technical_name"), text("p_partkey").alias("code"))
    return directory.coding_option_search(options, "Large  RING").select("p_partkey", "name", F.round("score", 4).alias("score"))


# --- directory: suppliers and customers as providers

BRANDS = ("MyChart North", "Oracle Health", "Clinic Web", "Epic Care")


def providers(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    none = F.lit(None)
    lat, lon = F.lit(41.0) + (k % 100) / 100.0, F.lit(-88.0) + (k % 37) / 100.0

    def option(n: int) -> Column:
        return F.struct(
            pick((k + n) % 4, *BRANDS).alias("access_brand"), F.concat(F.lit("https://h"), text(k % 9), F.lit(".example/fhir")).alias("fhir_base_url"), ((k * 7 + n * 31) % 100 / 100.0).alias("confidence"), F.lit("m").alias("match_method"), F.lit("why").alias("evidence"),
            none.cast("string").alias("raw_access_brand"), none.cast("string").alias("brand_family"), F.when(k % 3 == 0, F.lit(n + 1)).cast("int").alias("patient_display_priority"), F.lit("path").alias("evidence_path_class"), F.when(k % 2 == 0, F.lit(5 - n)).cast("int").alias("candidate_rank"),
        )

    kind = f"array<{directory.ENDPOINT_TYPE}>"
    options = F.when(k % 4 == 0, F.array().cast(kind)).when(k % 4 == 1, F.array(option(0)).cast(kind)).otherwise(F.array(option(0), option(1)).cast(kind))
    base = t.supplier.select(
        F.concat(F.lit("1"), F.lpad(text(k), 9, "0")).alias("npi"), F.col("s_name").alias("display_name"), F.lit("individual").alias("provider_type"), pick(k % 3, "Cardiology", "Family Medicine", "Oncology").alias("specialty"),
        F.lit("heart").alias("specialty_terms"), F.concat(F.lit("606"), F.lpad(text(k % 20), 2, "0")).alias("zip5"), F.lit("IL").alias("state"), F.concat(text(k), F.lit(" Main St")).alias("practice_line1"),
        F.when(k % 2 == 0, "Chicago").alias("practice_city"), F.lit("IL").alias("practice_state"), F.lit(None).cast("string").alias("practice_zip5"), F.when(k % 5 == 0, "Northwestern Medicine").alias("practice_organization_names"),
        F.when(k % 6 != 0, lat).alias("lat"), F.when(k % 6 != 0, lon).alias("lon"), options.alias("endpoint_options"),
    )
    return base


PROVIDERS_SQL = f"""
p AS (SELECT s_suppkey AS k, '1' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS npi, s_name AS display_name, {sql_pick('s_suppkey % 3', 'Cardiology', 'Family Medicine', 'Oncology')} AS specialty,
  CASE WHEN s_suppkey % 6 <> 0 THEN 41.0 + (s_suppkey % 100) / 100.0 END::DOUBLE AS lat, CASE WHEN s_suppkey % 6 <> 0 THEN -88.0 + (s_suppkey % 37) / 100.0 END::DOUBLE AS lon FROM supplier),
o AS (SELECT p.*, n AS pos, {sql_pick('(k + n) % 4', *BRANDS)} AS brand, ((k * 7 + n * 31) % 100 / 100.0)::DOUBLE AS conf, CASE WHEN k % 3 = 0 THEN n + 1 END AS prio, CASE WHEN k % 2 = 0 THEN 5 - n END AS crank
  FROM p, (SELECT unnest([0, 1]) AS n) WHERE k % 4 >= 2 OR (k % 4 = 1 AND n = 0)),
flat AS (
  SELECT k, npi, display_name, specialty, lat, lon, 'directory-' || npi || '-' || pos AS id, CASE WHEN brand = 'Oracle Health' THEN 'cerner' WHEN brand = 'Clinic Web' THEN 'unknown' ELSE 'epic' END AS vendor, CASE WHEN conf >= 0.9 THEN 'verified' ELSE 'candidate' END AS status, brand, conf, prio, crank, pos FROM o
  UNION ALL SELECT k, npi, display_name, specialty, lat, lon, 'directory-' || npi || '-provider', 'unknown', 'provider_only', 'Portal unknown', 0.0, NULL, NULL, NULL FROM p WHERE k % 4 = 0)
"""


@register(
    "directory_rows",
    f"WITH {PROVIDERS_SQL} SELECT id, vendor, status AS endpoint_status, brand AS access_brand, conf AS confidence, k || ' Main St ' || CASE WHEN k % 2 = 0 THEN 'Chicago, IL' ELSE 'IL' END || ' 606' || lpad(CAST(k % 20 AS VARCHAR), 2, '0') AS location FROM flat",
)
def directory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = directory.flatten_endpoints(directory.with_distance(providers(Tables(spark, sf_dir)), None))
    return out.select("id", "vendor", "endpoint_status", "access_brand", "confidence", "location")


DISTANCE_SQL = "2 * 3958.8 * atan2(sqrt(h), sqrt(1 - h))"
HAV_SQL = "pow(sin(radians(lat - 41.5) / 2), 2) + cos(radians(41.5)) * cos(radians(lat)) * pow(sin(radians(lon + 87.8) / 2), 2) AS h"


@register(
    "directory_search",
    f"""
WITH {PROVIDERS_SQL},
m AS (SELECT *, CASE WHEN k % 4 <> 0 THEN 20 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 35 ELSE 0 END AS rel FROM p WHERE specialty = 'Cardiology' AND k % 5 = 0),
b AS (SELECT npi, rel FROM m WHERE false),
q AS (SELECT k, npi, CASE WHEN k % 4 <> 0 THEN 20 ELSE 0 END AS rel, display_name FROM p WHERE specialty = 'Cardiology' AND k % 5 = 0 ORDER BY rel DESC, display_name, npi LIMIT 50)
SELECT f.id, f.display_name, q.rel AS relevance FROM q JOIN flat f ON f.npi = q.npi ORDER BY q.rel DESC, f.display_name, f.npi, f.pos
""",
)
def directory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.search(providers(Tables(spark, sf_dir)), "cardiology northwestern").select("id", "display_name", "relevance")


@register(
    "directory_search_by_distance",
    f"""
WITH {PROVIDERS_SQL}, d AS (SELECT *, {HAV_SQL} FROM p WHERE specialty = 'Oncology'), q AS (SELECT *, {DISTANCE_SQL} AS miles FROM d ORDER BY miles ASC NULLS LAST, CASE WHEN k % 4 <> 0 THEN 20 ELSE 0 END DESC, display_name LIMIT 30)
SELECT f.id, round(q.miles, 6) AS miles FROM q JOIN flat f ON f.npi = q.npi ORDER BY q.miles ASC NULLS LAST, CASE WHEN q.k % 4 <> 0 THEN 20 ELSE 0 END DESC, q.display_name, f.pos
""",
)
def directory_search_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = directory.search(providers(Tables(spark, sf_dir)), "ONCOLOGY", sort="distance", origin=(41.5, -87.8), limit=30)
    return out.select("id", F.round("distance_miles", 6).alias("miles"))


@register("zip_centroids", f"WITH {PROVIDERS_SQL} SELECT '606' || lpad(CAST(k % 20 AS VARCHAR), 2, '0') AS zip5, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS n FROM p WHERE lat IS NOT NULL GROUP BY ALL")
def zip_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.zip_centroid(providers(Tables(spark, sf_dir))).select("zip5", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n")


@register(
    "customer_distances",
    f"WITH c AS (SELECT c_custkey, (41.0 + (c_custkey % 100) / 100.0)::DOUBLE AS lat, (-88.0 + (c_custkey % 37) / 100.0)::DOUBLE AS lon FROM customer), d AS (SELECT *, {HAV_SQL} FROM c) SELECT c_custkey, round({DISTANCE_SQL}, 6) AS miles FROM d",
)
def customer_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lat, lon = F.lit(41.0) + (k % 100) / 100.0, F.lit(-88.0) + (k % 37) / 100.0
    return Tables(spark, sf_dir).customer.select("c_custkey", F.round(geometry.haversine_miles(F.lit(41.5), F.lit(-87.8), lat, lon), 6).alias("miles"))


@register(
    "origins",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 90) + 0.5 END::DOUBLE AS lat, CASE WHEN c_custkey % 3 = 0 THEN -(c_custkey % 70)::DOUBLE END AS lon, CASE WHEN c_custkey % 3 = 1 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') END AS zip FROM customer",
)
def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    words = F.when(k % 3 == 0, F.concat(F.lit(" "), text(k % 90), F.lit(".5 , -"), text(k % 70))).when(k % 3 == 1, F.concat(F.lit("near "), F.lpad(text(k), 5, "0"), F.lit(", IL"))).otherwise(F.concat(text(k), F.lit("1x")))
    rows = Tables(spark, sf_dir).customer.select("c_custkey", words.alias("w"))
    p = geometry.coordinate_pair(F.col("w"))
    return rows.select("c_custkey", p["lat"].alias("lat"), p["lon"].alias("lon"), geometry.zip_code(F.col("w")).alias("zip"))


@register("provider_by_id", f"WITH {PROVIDERS_SQL} SELECT id, display_name FROM flat WHERE (k % 4 = 0 AND k % 3 = 0) OR (k % 4 <> 0 AND pos = 0 AND k % 3 = 0)")
def provider_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = providers(Tables(spark, sf_dir))
    tail = F.explode(F.array(F.lit("-0"), F.lit("-7"), F.lit("-provider"), F.lit("-x")))
    ids = rows.filter("cast(npi as bigint) % 3 = 1").select("npi", tail.alias("tail")).select(F.concat(F.lit("directory-"), "npi", "tail").alias("id"))
    return directory.find_provider(ids, rows).select("id", "display_name")


@register(
    "provider_options",
    f"""
WITH {PROVIDERS_SQL} SELECT id, count(*) OVER (PARTITION BY npi) AS n_options, CAST(row_number() OVER (PARTITION BY npi ORDER BY coalesce(prio, 99), coalesce(crank, 99), conf DESC, brand, id) AS INTEGER) AS option_rank FROM flat
""",
)
def provider_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = directory.flatten_endpoints(directory.with_distance(providers(Tables(spark, sf_dir)), None))
    groups, ranked_options = directory.group_options(flat)
    return ranked_options.join(groups.select("npi", "n_options"), "npi").select("id", "n_options", "option_rank")


@register("vendors", f"SELECT page_id, CASE WHEN contains(lower(url), 'cerner') OR contains(lower(url), 'oracle') OR page_id % 4 = 1 THEN 'cerner' WHEN contains(lower(url), 'epic') OR page_id % 4 IN (0, 3) THEN 'epic' ELSE 'unknown' END AS vendor FROM pages")
def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).pages.select("page_id", directory.infer_vendor(F.col("url"), pick(F.col("page_id") % 4, *BRANDS)).alias("vendor"))
