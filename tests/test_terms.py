import math
import random
import re

from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.operators import bm25, builds, classify, directory, terminology


def test_weight_falls_back_to_shorter_codes(spark):
    weights = spark.createDataFrame([("E11", 0.21), ("E11.9", 0.25), ("J45.9", 0.14), ("F32", 0.49)], "code string, weight double")
    codes = spark.createDataFrame([("J45.909",), ("F32.42",), ("I10",), (" e11 ",), ("E11.901",), ("E11.",)], "code string")
    got = {r.code: r.weight for r in terminology.weights_by_code(codes, weights).collect()}
    assert got == {"J45.909": 0.14, "F32.42": 0.49, "I10": 0.0, " e11 ": 0.21, "E11.901": 0.25, "E11.": 0.0}


def test_most_specific_term_wins(spark):
    terms = spark.createDataFrame(
        [("rxnorm", "860975", "Metformin 500 MG", "exact", "SCD"), ("rxnorm", "6809", "Metformin", "exact", "IN"), ("rxnorm", "1", "Metformin Pack", "broader", "GPCK"), ("rxnorm", "2", "Aspirin Pack", "exact", "GPCK")],
        "system string, code string, name string, match_type string, tty string",
    ).withColumns({"canonical_system": F.lit(None).cast("string"), "canonical_code": F.lit(None).cast("string")})
    rows = [("a", ["rxnorm:6809", "rxnorm:860975"]), ("b", ["rxnorm:860975", "RXNORM:1"]), ("c", ["rxnorm:2", "rxnorm:6809"]), ("d", ["rxnorm:none"])]
    df = spark.createDataFrame([(i, "MedicationRequest", k, ["metformin"], "x", [], []) for i, k in rows], "id string, resource_type string, coding_keys array<string>, ingredients array<string>, source_label string, code_texts array<string>, code_codings array<struct<code:string,display:string>>")
    got = {r.id: (r.code, r.confidence) for r in terminology.friendly_names(df, terms, ["id"]).collect()}
    assert got == {"a": ("860975", 0.96), "b": ("1", 0.76), "c": ("6809", 0.96)}


def test_medication_name_tiers(spark):
    meds = spark.createDataFrame([(1, "Anything"), (2, "Amlodipine / Zinc"), (3, "Metformin Oral Product"), (4, "mesotherapy"), (5, "Vitamin B-12 shot")], "k int, name string")
    codes = spark.createDataFrame([(1, "860975")], "k int, code string")
    parts = spark.createDataFrame([("860975", "Metformin")], "product_code string, ingredient_name string")
    pairs = spark.createDataFrame([("Diabetes Type 2", "Metformin"), ("Hypertension", "amlodipine"), ("Acid", "meso"), ("Anemia", "b-12")], "condition_name string, related_name string")
    got = {(r.k, r.condition_name, r.tier) for r in terminology.medication_name_conditions(meds, codes, parts, pairs, ["k"]).collect()}
    assert got == {(1, "Diabetes Type 2", 1), (2, "Hypertension", 2), (3, "Diabetes Type 2", 3), (5, "Anemia", 3)}


def test_text_functions(spark):
    df = spark.createDataFrame([("Patient/abc",), ("",), ("é€x",)], "s string")

    def fnv(s):
        h = 2166136261
        for ch in s:
            h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"
        out = ""
        while h:
            h, d = divmod(h, 36)
            out = digits[d] + out
        return out

    assert [r.h for r in df.select(T.fnv1a_base36(F.col("s")).alias("h")).collect()] == [fnv(s) for s in ("Patient/abc", "", "é€x")]
    row = spark.createDataFrame([("acetaminophen/caffeine-IR 5ml", "vitamin b12-complex")], "a string, b string").select(
        T.title_words(F.col("a")).alias("words"), builds.medication_title(F.col("b")).alias("letters"), T.sorted_distinct(F.array(F.lit(" b"), F.lit("a"), F.lit("b"), F.lit(" "), F.lit(None))).alias("sorted"),
    ).first()
    assert row.words == "Acetaminophen/Caffeine-IR 5ml" and row.letters == "Vitamin B12-Complex".title() and row.sorted == ["a", "b"]
    nums = spark.createDataFrame([(180.0,), (7.2,), (0.0001,), (12345678.5,), (-3.0,)], "v double").select(T.number_text(F.col("v")).alias("t"))
    assert [r.t for r in nums.collect()] == ["180", "7.2", "0.0001", "12345678.5", "-3"]


def reference_tokens(text):
    out = []
    for w in re.findall("[a-z]{3,}", text.lower()):
        if w in bm25.STOP_WORDS:
            continue
        for s in sorted(bm25.SUFFIXES, key=len, reverse=True):
            if w.endswith(s) and len(w) > len(s) + 2:
                w = w[: -len(s)]
                break
        out.append(w)
    return out


def test_search_against_a_plain_model(spark):
    rnd = random.Random(5)
    stock = ["medication", "tests", "happiness", "running", "al", "sedly", "blood", "sugar", "sugars", "the", "ably", "painful", "carelessness", "zed", "bodies", "x1y"]
    docs = [(("a", "b")[n % 2], n, " ".join(rnd.choice(stock) for _ in range(rnd.randrange(1, 30)))) for n in range(60)]
    queries = [(("a", "b")[n % 2], n, " ".join(rnd.choice(stock) for _ in range(6))) for n in range(10)]
    got_tokens = [r.t for r in spark.createDataFrame(docs, "category string, rid int, text string").select("rid", bm25.tokens(F.col("text")).alias("t")).orderBy("rid").collect()]
    assert got_tokens == [reference_tokens(d[2]) for d in docs]
    want = {}
    for cat in "ab":
        own = [(rid, reference_tokens(t)) for c, rid, t in docs if c == cat]
        avg, n = sum(len(t) for _, t in own) / len(own), len(own)
        for qc, qid, q in queries:
            if qc != cat:
                continue
            scores = {}
            for term in reference_tokens(q):
                df = sum(term in t for _, t in own)
                for rid, t in own:
                    if term in t:
                        idf, tf = math.log(1 + (n - df + 0.5) / (df + 0.5)), t.count(term)
                        scores[rid] = scores.get(rid, 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
            want[qid] = sorted(((-round(s, 9), rid) for rid, s in scores.items()))[:3]
    for salt in (1, 3):
        index = bm25.build_index(spark.createDataFrame(docs, "category string, rid int, text string"), salt)
        ranked = bm25.search(spark.createDataFrame(queries, "category string, qid int, query string"), index["postings"], 3, salt)
        got = {}
        for r in ranked.orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.rid)
        assert got == {q: [rid for _, rid in v] for q, v in want.items() if v}


def test_allergies_and_visits(spark):
    df = spark.createDataFrame([("No known allergies",), ("NKDA",), ("Peanut allergy",), ("Office visit AMB",), ("EMER",), ("video visit",)], "t string")
    rows = df.select(classify.classify_allergy(T.norm_text(F.col("t"))).alias("a"), classify.classify_visit(T.norm_text(F.col("t"))).alias("v")).collect()
    assert [(r.a.label, r.a.domain) for r in rows[:3]] == [("negative_assertion", "generic"), ("negative_assertion", "drug"), ("specific_allergy", "food")]
    assert [r.v.label for r in rows[3:]] == ["outpatient", "emergency", "telehealth"]


def test_causes_need_borders(spark):
    seq = spark.createDataFrame([("Mild diabetes mellitus type 2, treated",), ("Prediabetes mellitus",), ("Anemia (iron)",), ("HIV/AIDS",)], "sequela string")
    causes = spark.createDataFrame([("Diabetes mellitus",), ("Diabetes mellitus type 2",), ("iron",), ("HIV/AIDS",), ("AIDS",)], "cause string")
    got = {r.sequela: r.cause for r in builds.match_causes(seq, causes).collect()}
    assert got == {"Mild diabetes mellitus type 2, treated": "Diabetes mellitus type 2", "HIV/AIDS": "HIV/AIDS"}


def test_code_ranges(spark):
    df = spark.createDataFrame([(1, "A50-A52.9"), (2, "A50-A529"), (3, "A99-B01"), (4, "x, I98; i980")], "k int, codes string")
    got = {}
    for r in builds.expand_code_ranges(df, ["k"]).collect():
        got.setdefault(r.k, set()).add(r.code)
    assert got[1] == {"A50", "A52.9"} and got[3] == {"A99", "B01"} and got[4] == {"I98", "I980"}
    assert len(got[2]) == 33 and {"A50", "A50.0", "A51.9", "A52.9"} <= got[2]


def test_directory(spark):
    opt = f"array(cast(named_struct('access_brand','MyChart','fhir_base_url','https://x','confidence',0.7179D,'match_method','m','evidence','e','raw_access_brand',null,'brand_family',null,'patient_display_priority',1,'evidence_path_class','c','candidate_rank',null) as {directory.ENDPOINT_TYPE}))"
    row = "select '{npi}' npi, '{name}' display_name, 'individual' provider_type, 'Cardiology' specialty, '' specialty_terms, '60611' zip5, 'IL' state, '1 Main' practice_line1, 'Chicago' practice_city, 'IL' practice_state, cast(null as string) practice_zip5, '{org}' practice_organization_names, {lat} lat, -87.6D lon, {opt} endpoint_options"
    none = f"cast(array() as array<{directory.ENDPOINT_TYPE}>)"
    df = spark.sql(row.format(npi="1", name="Ann", org="Northwestern", lat="41.9D", opt=opt) + " union all " + row.format(npi="2", name="Bob", org="", lat="cast(null as double)", opt=none))
    got = directory.search(df, "cardiology northwestern").collect()
    assert [(r.id, r.endpoint_status, r.vendor) for r in got] == [("directory-1-0", "candidate", "epic")]
    got = directory.search(df, "cardiology", sort="distance", origin=(41.9, -87.6)).collect()
    assert [r.id for r in got] == ["directory-1-0", "directory-2-provider"] and got[0].distance_miles < 1e-6
    assert directory.search(df, "c").count() == 0
