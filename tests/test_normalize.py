from pyspark.sql import functions as F

from recordloom.operators import normalize, records
from recordloom.operators.normalize import observation_value, value_fields


def values(df):
    return [r["v"] for r in df.select("input_pos", value_fields(F.col("body")).alias("p")).select("input_pos", observation_value(F.col("p")).alias("v")).orderBy("input_pos").collect()]


def test_observation_values(resources):
    got = values(
        resources(
            {"resourceType": "Observation", "valueQuantity": {"value": 180, "unit": "lb", "code": "[lb_av]"}},
            {"resourceType": "Observation", "valueCodeableConcept": {"text": "Positive"}},
            {"resourceType": "Observation", "dataAbsentReason": {"text": "Not asked"}},
            {"resourceType": "Observation", "valueQuantity": {"value": "7"}, "valueString": "seven"},
            {"resourceType": "Observation", "valuePeriod": {"end": "2024-01-02"}},
            {"resourceType": "Observation", "valueQuantity": {"value": 98.6, "unit": "degF", "comparator": ">"}},
            {"resourceType": "Observation"},
        )
    )
    assert got[0].display == "180 lb" and round(got[0].canonical_value, 4) == 81.6466 and got[0].canonical_unit == "kg"
    assert [v.kind for v in got] == ["quantity", "codeable-concept", "absent", "string", "period", "quantity", "unknown"]
    assert got[1].numeric_value is None and got[2].absent_reason == "Not asked"
    assert got[5].display == "> 98.6 degF" and round(got[5].canonical_value, 6) == 37.0
    assert got[6].display == "No value recorded"


def test_single_concept_where_a_list_is_usual(resources):
    df = normalize.observations(
        resources(
            {"resourceType": "Observation", "id": "a", "category": {"text": "Lab", "coding": [{"code": "laboratory"}]}, "interpretation": {"coding": [{"code": "h"}]}},
            {"resourceType": "Observation", "id": "b", "category": [{"coding": [{"code": "vital-signs"}]}], "interpretation": [{"coding": [{"code": "N"}]}]},
        )
    )
    a, b = df.orderBy("id").collect()
    assert (a.category, a.category_code, a.abnormal) == ("Lab", "laboratory", True)
    assert (b.category, b.category_code, b.abnormal) == ("vital-signs", "vital-signs", False)


def test_medication_uses_the_referenced_product(resources):
    df = normalize.medications(
        resources(
            {"resourceType": "Medication", "id": "m1", "code": {"text": "Metformin 500", "coding": [{"system": "http://www.nlm.nih.gov/research/umls/rxnorm", "code": "860975"}]}, "form": {"text": "Tablet"},
             "ingredient": [{"itemCodeableConcept": {"text": "metformin"}}, {"itemReference": {"display": "filler"}}]},
            {"resourceType": "MedicationRequest", "id": "r1", "medicationReference": {"reference": "Medication/m1"}, "dosageInstruction": [{"text": "take one"}]},
            {"resourceType": "MedicationRequest", "id": "r2", "medicationReference": {"reference": "Medication/none", "display": "Shown"}},
            {"resourceType": "MedicationRequest", "medicationCodeableConcept": {"coding": [{"code": "x1"}]}, "status": "active"},
        )
    )
    rows = {r.id: r for r in df.collect()}
    assert rows["r1"].label == "Metformin 500" and rows["r1"].ingredients == ["metformin", "filler"] and rows["r1"].route == "Oral"
    assert rows["r1"].coding_keys == ["rxnorm:860975"] and rows["r1"].status == "unknown"
    assert rows["r2"].label == "Shown" and rows["r2"].code_summary.text == "Shown"
    assert rows["pos-3"].label == "x1" and rows["pos-3"].coding_keys == ["x1"]


def test_coding_systems(resources):
    codings = [
        {"system": "urn:oid:2.16.840.1.113883.6.88", "code": "1"}, {"system": "2.16.840.1.113883.6.1", "code": "2"}, {"system": "urn:oid:1.2.3", "code": "3"},
        {"system": "http://snomed.info/sct", "code": "4"}, {"system": "http://x", "code": "5"}, {"code": "6"}, {"system": "http://loinc.org", "display": "no code"}, {"system": "http://loinc.org", "code": "2"},
    ]
    row = normalize.conditions(resources({"resourceType": "Condition", "id": "c", "code": {"coding": codings}})).first()
    assert row.coding_keys == ["rxnorm:1", "loinc:2", "oid:1.2.3:3", "snomed:4", "http://x|5", "6"]
    assert row.label == "no code"


def test_unify_and_overlay(spark, resources):
    rows = resources(
        {"resourceType": "Condition", "id": "c1", "code": {"text": "Cough"}, "clinicalStatus": {"coding": [{"code": "active"}]}},
        {"resourceType": "DiagnosticReport", "id": "d1", "code": {"text": "Panel"}, "result": [{"reference": "Observation/1"}]},
        {"resourceType": "Encounter", "id": "e1", "class": {"code": "AMB"}, "period": {"end": "2024-02-03"}},
    )
    unified = records.unify(normalize.typed_summary(rows))
    patches = spark.createDataFrame([("p1", "Condition", "c1", "patientRecordVisibility", "hidden"), ("p1", "Encounter", "e1", "patientRecordStatus", "inactive")], "patient_id string, target_type string, target_id string, field string, value string")
    got = {r.id: r for r in records.overlay_patches(unified, patches).collect()}
    assert got["c1"].hidden and not got["c1"].inactive_overlay and got["e1"].inactive_overlay
    assert got["d1"].display_value == "1 linked result" and got["e1"].date == "2024-02-03" and got["e1"].source_label == "AMB"


def test_requests_are_read_before_they_meet_their_medications(spark, resources):
    codes = lambda system, code: {"text": f"Text {code}", "coding": [{"system": system, "code": code}]}
    found = normalize.medications(
        resources(
            {"resourceType": "Medication", "id": "m1", "code": codes("urn:oid:2.16.840.1.113883.6.69", "7"), "form": {"text": "Eye drops"}, "ingredient": [{"itemReference": {"display": "Salt"}}]},
            {"resourceType": "MedicationRequest", "id": "a", "medicationReference": {"reference": "Medication/m1"}, "status": "active"},
            {"resourceType": "MedicationRequest", "id": "b", "medicationCodeableConcept": codes("http://www.nlm.nih.gov/research/umls/RxNorm", "5"), "dosageInstruction": [{"text": "under the  tongue"}, {"route": {"text": "Given"}}]},
            {"resourceType": "MedicationRequest", "id": "c", "medicationReference": {"reference": "Medication/gone"}, "dosageInstruction": [{"text": "gelatine, then by MOUTH."}]},
            {"resourceType": "MedicationRequest", "code": {"coding": [{"code": "9"}]}, "authoredOn": "2024-01-01", "dosageInstruction": "none"},
        )
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "try_variant_get" not in plan[: plan.index("Join")]  # no body is carried through the join
    got = {r.id: (r.label, r.status, r.coding_keys, r.ingredients, r.dosage_form, r.route, r.authored_at) for r in found.collect()}
    assert got == {
        "a": ("Text 7", "active", ["ndc:7"], ["Salt"], "Eye drops", "Ophthalmic", None),
        "b": ("Text 5", "unknown", ["rxnorm:5"], [], None, "Given", None),
        "c": ("Medication/gone", "unknown", [], [], None, "Oral", None),
        "pos-4": ("9", "unknown", [], [], None, None, "2024-01-01"),
    }


def test_a_route_is_named_by_whole_words(spark):
    given = {"Gel cap": "Topical", "gelatine": None, "into the ear": None, "in-the-ear": "Otic", "EAR DROPS": "Otic", "oral patch": "Transdermal", "pen injector": "Injection", "iv.": "Intravenous", " ": None, "by mouth; sublingual": "Sublingual"}
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", normalize.route_words(F.col("t")).alias("words"))
    assert {r.t: r.route for r in rows.select("t", normalize.infer_route(F.col("words")).alias("route")).collect()} == given
