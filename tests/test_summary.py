from pyspark.sql import functions as F

from recordloom.plans.patient_summary import Terminology, classified_records, summarise


def loinc(code, text):
    return {"text": text, "coding": [{"system": "http://loinc.org", "code": code}]}


def test_one_patient_end_to_end(spark, resources):
    obs = lambda i, day, value: {"resourceType": "Observation", "id": i, "status": "final", "code": loinc("4548-4", "HbA1c"), "category": [{"coding": [{"code": "laboratory"}]}], "effectiveDateTime": f"2024-01-{day:02d}", "valueQuantity": {"value": value, "unit": "%", "code": "%"}}
    rows = resources(
        {"resourceType": "Condition", "id": "c1", "code": {"text": "T2DM", "coding": [{"system": "http://hl7.org/fhir/sid/icd-10-cm", "code": "E11.9"}]}, "clinicalStatus": {"text": "active"}},
        {"resourceType": "Condition", "id": "c2", "code": {"text": "chronic cough illness"}},
        {"resourceType": "MedicationRequest", "id": "m1", "status": "active", "medicationCodeableConcept": {"text": "metformin tablet", "coding": [{"system": "http://www.nlm.nih.gov/research/umls/rxnorm", "code": "860975"}]}},
        {"resourceType": "Encounter", "id": "e1", "class": {"code": "EMER"}, "reasonReference": [{"reference": "Condition/c1"}]},
        obs("o1", 1, 6.0), obs("o2", 2, 6.8), obs("o3", 3, 7.4),
    )
    out = summarise(rows, *inputs(spark), now_ms=1_706_745_600_000)
    check_one_patient(out)


def inputs(spark):
    """Patients, patches and small terminology tables."""
    none = F.lit(None).cast("string")
    terms = spark.createDataFrame([("icd10cm", "E11.9", "Diabetes Type 2"), ("loinc", "4548-4", "Hemoglobin A1c"), ("rxnorm", "860975", "Metformin")], "system string, code string, name string").withColumns({"match_type": F.lit("exact"), "tty": none, "canonical_system": none, "canonical_code": none})
    corpus = spark.createDataFrame([("condition", n, t, t, t, f"R0{n}", "icd10cm") for n, t in enumerate(["Chronic cough"] + ["Broken bone", "Mild fever", "Sore throat", "Ear pain", "Flat foot", "Back ache"] * 20)], "category string, rid int, text string, name string, friendly_name string, code string, system string")
    t = Terminology(
        terms, corpus, spark.createDataFrame([("E11", 0.21)], "code string, weight double"),
        spark.sql("select 'a1c' range_id, '4548-4' code, cast(array() as array<string>) alternate_codes, 'Hemoglobin A1c' name, cast(array() as array<string>) aliases, '%' unit, cast(null as double) molecular_weight, cast(null as struct<low:double,high:double>) male, cast(null as struct<low:double,high:double>) female, named_struct('low', 4.0d, 'high', 5.6d) default"),
        spark.createDataFrame([("E11", 0, "4548-4", "strong")], "condition_code string, pos int, code string, strength string"),
        spark.createDataFrame([("E11", 0, "6809", "strong")], "condition_code string, condition_pos int, code string, strength string"),
        spark.createDataFrame([("860975", 0, "6809", "metformin")], "product_code string, pos int, ingredient_code string, ingredient_name string"),
    )
    patients = spark.createDataFrame([("p1", "female", 60)], "patient_id string, sex string, age int")
    patches = spark.createDataFrame([], "patient_id string, target_type string, target_id string, field string, value string")
    return patients, patches, t


def check_one_patient(out):
    names = {r.name for r in out.groups.collect()}
    assert {"Diabetes Type 2", "Hemoglobin A1c", "Metformin", "Chronic cough"} <= names
    assert {(r.source_type, r.target_group) for r in out.group_edges.collect()} == {("Observation", "Condition:condition-diabetes-type-2"), ("MedicationRequest", "Condition:condition-diabetes-type-2")}
    trend = out.trends.first()
    assert (trend.direction, trend.point_count, trend.latest) == ("up", 3, 7.4)
    assert out.flags.first().out_of_range is True
    scores = {r.name: round(r.score, 4) for r in out.ranked.collect()}
    assert scores["Diabetes Type 2"] == round(0.7 * 0.21 + 0.10 + 0.05 * 0.96, 4)
    assert scores["Hemoglobin A1c"] == round(0.3 * 0.21 + 0.10 + 0.05 * 0.96 + 0.03, 4)
    classes = {r.id: r.label for r in classified_records(out.records).collect()}
    assert classes["e1"] == "emergency" and classes["o1"] == "labs"


def test_equal_ids_of_other_types_and_portals_stay_apart(spark, resources):
    def lab(i, code, text, day, value):
        return {"resourceType": "Observation", "id": i, "status": "final", "code": loinc(code, text), "category": [{"coding": [{"code": "laboratory"}]}], "effectiveDateTime": f"2024-01-{day:02d}", "valueQuantity": {"value": value, "unit": "mmol/L", "code": "mmol/L"}}

    first = resources(*[{"resourceType": "Condition", "id": str(n), "code": {"text": "Cough"}} for n in (1, 2, 3)], *[lab(str(n), "2951-2", "Sodium", n, 140.0 + n) for n in (1, 2, 3)], source="north")
    second = resources(*[lab(str(n), "2823-3", "Potassium", n, 4.0 + n) for n in (1, 2, 3)], source="south")
    other = first.withColumn("patient_id", F.lit("p2")).filter("resource_type = 'Observation' and id <> '3'")
    out = summarise(first.unionByName(second).unionByName(other), *inputs(spark), now_ms=1_706_745_600_000)
    names = {(r.patient_id, r.group_id): r.name for r in out.groups.collect()}
    held = {}
    for r in out.members.collect():
        held.setdefault((r.patient_id, names[r.patient_id, r.group_id]), set()).add(r.record_id)
    assert held == {
        ("p1", "Cough"): {f"north:Condition:{n}" for n in (1, 2, 3)},
        ("p1", "Sodium"): {f"north:Observation:{n}" for n in (1, 2, 3)},
        ("p1", "Potassium"): {f"south:Observation:{n}" for n in (1, 2, 3)},
        ("p2", "Sodium"): {f"north:Observation:{n}" for n in (1, 2)},
    }
    trends = {(r.patient_id, names[r.patient_id, r.group_id]): (r.point_count, r.latest) for r in out.trends.collect()}
    assert trends[("p1", "Sodium")] == (3, 143.0) and trends[("p1", "Potassium")] == (3, 7.0)
    assert ("p1", "Cough") not in trends


def test_names_in_any_script_and_of_any_length_stay_apart(spark, resources):
    long = "x" * 70
    rows = resources(*[{"resourceType": "Condition", "id": str(n), "code": {"text": t}} for n, t in enumerate(["糖尿病", "高血圧", long + " one", long + " two"])])
    out = summarise(rows, *inputs(spark), now_ms=1_706_745_600_000)
    assert {r.name for r in out.groups.collect()} == {"糖尿病", "高血圧", long + " one", long + " two"}


def test_members_vouch_for_links_and_copies_count_once(spark, resources):
    def lab(i, status, hour=9):
        return {"resourceType": "Observation", "id": i, "status": status, "code": loinc("4548-4", "HbA1c"), "category": [{"coding": [{"code": "laboratory"}]}], "effectiveDateTime": f"2024-01-20T{hour:02d}:00:00Z", "valueQuantity": {"value": 7.0, "unit": "%", "code": "%"}}

    diabetes = {"resourceType": "Condition", "id": "c1", "code": {"text": "T2DM", "coding": [{"system": "http://hl7.org/fhir/sid/icd-10-cm", "code": "E11.9"}]}}
    drug = {"resourceType": "MedicationRequest", "id": "m1", "status": "active", "medicationCodeableConcept": {"text": "metformin tablet", "coding": [{"system": "http://www.nlm.nih.gov/research/umls/rxnorm", "code": "860975"}]}}
    north, south = resources(diabetes, drug, lab("o1", "final"), source="north"), resources(lab("x1", "final", 10), source="south")
    early = resources(diabetes, lab("o1", "registered"), source="north").withColumn("patient_id", F.lit("p2"))
    out = summarise(north.unionByName(south).unionByName(early), *inputs(spark), now_ms=1_706_745_600_000)
    assert {(r.patient_id, r.source_type) for r in out.group_edges.collect()} == {("p1", "Observation"), ("p1", "MedicationRequest")}
    names = {(r.patient_id, r.group_id): r.name for r in out.groups.collect()}
    cards = {(r.patient_id, names[r.patient_id, r.group_id]): (r.n_records, r.n_duplicates, r.n_portals) for r in out.extra["cards"].collect()}
    assert cards[("p1", "Hemoglobin A1c")] == (1, 1, 2) and cards[("p2", "Hemoglobin A1c")] == (1, 0, 1)
    shown = {(r.patient_id, r.name) for r in out.extra["overview"].collect()}
    assert shown == {("p1", "Diabetes Type 2"), ("p2", "Diabetes Type 2"), ("p2", "Hemoglobin A1c")}
