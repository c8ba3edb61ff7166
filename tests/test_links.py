from pyspark.sql import functions as F

from recordloom.functions.links import local_reference, server_reference
from recordloom.operators import references, relationships


def test_edges_and_hops(resources):
    rows = resources(
        {"resourceType": "Condition", "id": "c1"},
        {"resourceType": "Encounter", "id": "e1", "reasonReference": [{"reference": "Condition/c1"}], "partOf": {"reference": "Encounter/e1"}},
        {"resourceType": "Observation", "id": "o1", "encounter": {"reference": "https://h/r4/Encounter/e1?x=1"}, "basedOn": [{"reference": "ServiceRequest/s"}]},
        {"resourceType": "Observation", "id": "o2", "derivedFrom": [{"reference": "#inner"}, {"reference": "Observation/gone"}]},
        {"resourceType": "DiagnosticReport", "id": "d1", "encounter": {"reference": "/Encounter/e1/_history/2"}, "result": [{"reference": "Observation/o2"}]},
    )
    edges = relationships.explicit_edges(rows)
    assert {(e.src, e.dst, e.kind) for e in edges.collect()} == {
        ("Encounter/s1:e1", "Condition/s1:c1", "reason"),
        ("Observation/s1:o1", "Encounter/s1:e1", "encounter"),
        ("DiagnosticReport/s1:d1", "Encounter/s1:e1", "encounter"),
        ("DiagnosticReport/s1:d1", "Observation/s1:o2", "result"),
    }
    pairs = {tuple(r) for r in relationships.observation_conditions(edges).collect()}
    assert pairs == {("Observation/s1:o1", "Condition/s1:c1"), ("Observation/s1:o2", "Condition/s1:c1")}


def test_nested_diagnosis(resources):
    rows = resources({"resourceType": "Condition", "id": "c"}, {"resourceType": "Encounter", "id": "e", "diagnosis": [{"condition": {"reference": "Condition/c"}}, {"use": {}}]})
    assert [(e.kind, e.label) for e in relationships.explicit_edges(rows).collect()] == [("diagnosis", "Visit diagnosis")]


def test_reference_parsing(spark):
    df = spark.createDataFrame([("Condition/a%20b",), ("x/y/Encounter/1/_history/7",), ("Medication/1",), ("#x",), ("Encounter/%zz",), ("",), ("Encounter/a+b",)], "r string")
    got = [r.t and (r.t.resource_type, r.t.id) for r in df.select(local_reference(F.col("r")).alias("t")).collect()]
    assert got == [("Condition", "a b"), ("Encounter", "1"), None, None, None, None, ("Encounter", "a+b")]
    df = spark.createDataFrame([("Patient/1",), ("https://H.org/fhir/Patient/2?x",), ("https://other/Patient/3",), ("/Patient/4#f",), ("12/5",)], "r string")
    got = [r.t and (r.t.resource_type, r.t.id, r.t.url) for r in df.select(server_reference(F.col("r"), F.lit("https://h.org/fhir/")).alias("t")).collect()]
    assert got == [("Patient", "1", "https://h.org/fhir/Patient/1"), ("Patient", "2", "https://h.org/fhir/Patient/2"), None, ("Patient", "4", "https://h.org/fhir/Patient/4"), None]


def test_missing_reference(spark, resources):
    rows = resources({"resourceType": "MedicationRequest", "id": "r", "medicationReference": {"reference": "Medication/med-1"}}, {"resourceType": "Observation", "id": "o", "encounter": {"reference": "Encounter/e"}})
    out = references.missing_references(references.display_references(rows), rows.select("source_id", "resource_type", "id"), F.lit("https://h"), F.lit("patient/Medication.read"))
    got = {r.target_id: r for r in out.collect()}
    assert not got["med-1"].skipped and got["med-1"].url == "https://h/Medication/med-1" and got["e"].skipped
    assert "referenced Medication" in got["med-1"].reason


def test_claims_prefer_the_first_association_and_codes(spark):
    conditions = spark.createDataFrame([("p", "Condition:a", 0, "E11.9", "Sugar"), ("p", "Condition:b", 1, None, "I10"), ("p", "Condition:c", 2, "I10", "Pressure")], "patient_id string, group_key string, group_pos int, code string, name string")
    found = spark.createDataFrame([("p", "m1", "X99", 0), ("p", "m1", "I10", 1), ("p", "m1", "E11", 2), ("p", "m2", "E11", 0), ("p", "m3", "E1", 0)], "patient_id string, source_group string, condition_code string, assoc_pos int")
    got = {r.medication_group: r.condition_group for r in relationships.claim_medications(found, conditions).collect()}
    assert got == {"m1": "Condition:c", "m2": "Condition:a"}


def test_free_ids_fill_the_first_gap(spark):
    from recordloom.operators import grouping

    taken = ["a", "a-fallback-1", "a-fallback-2", "a-fallback-4", "b-fallback-1", "c", "c-fallback-02", "c-fallback-3", "d-fallback-1", "d", "d-fallback-1-fallback-1", "a"] + [f"e-fallback-{n}" for n in range(1, 400)] + ["e"]
    wanted = ["a", "b", "c", "d", "d-fallback-1", "e", "f"]
    rows = [("p", t) for t in taken] + [("q", "f")]
    got = grouping.free_ids(spark.createDataFrame([("p", w) for w in wanted], "patient_id string, group_id string"), spark.createDataFrame(rows, "patient_id string, group_id string"))
    assert {r.group_id: r._new for r in got.collect()} == {"a": "a-fallback-3", "b": "b", "c": "c-fallback-1", "d": "d-fallback-2", "d-fallback-1": "d-fallback-1-fallback-2", "e": "e-fallback-400", "f": "f"}
