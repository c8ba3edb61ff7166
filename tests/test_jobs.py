import json

import pytest
from pyspark.sql import functions as F

from recordloom.operators import model_output
from recordloom.plans.catalog import ORACLES, QUERIES
from recordloom.sources import bundles, export, terminology
from recordloom.streaming import incremental


def test_read_bundles(spark, tmp_path):
    for n in range(3):
        body = {"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient", "id": f"p{n}"}}, {"request": {}}, {"resource": {"resourceType": "Condition", "id": "c"}}]}
        (tmp_path / f"b{n}.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "other.json").write_text('{"resourceType": "Patient", "id": "alone"}')
    (tmp_path / "broken.json").write_text("{")
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    df = bundles.read_bundles(spark, str(tmp_path), name, name)
    at = lambda n, p: (n << bundles.FILE_BITS) + p
    assert sorted((r.source_id, r.input_pos, r.resource_type, r.id) for r in df.collect()) == sorted((f"b{n}", at(n, p), t, i) for n in range(3) for p, t, i in ((0, "Patient", f"p{n}"), (2, "Condition", "c")))


def test_pages_of_two_portals_keep_nameless_resources_apart(spark, tmp_path):
    for source in ("north", "south"):
        for page in range(3):
            body = {"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Observation", "status": f"{source}{page}{n}"}} for n in range(2)]}
            (tmp_path / f"{source}-page{page} x.json").write_text(json.dumps(body))
    df = bundles.read_bundles(spark, str(tmp_path), F.regexp_extract("path", r"(north|south)", 1), F.lit("p"))
    rows = sorted((r.source_id, r.input_pos, r.status) for r in df.select("source_id", "input_pos", F.expr("try_variant_get(body, '$.status', 'string')").alias("status")).collect())
    assert [r[2] for r in rows] == [f"{s}{p}{n}" for s in ("north", "south") for p in range(3) for n in range(2)]
    assert len({r[1] for r in rows}) == 12


def test_resource_lines_are_split_and_keep_their_order(spark, tmp_path):
    for f in range(2):
        lines = [json.dumps({"resourceType": "Observation", "id": f"{f}-{n:04d}", "note": "x" * (n % 90)}) for n in range(900)]
        (tmp_path / f"part{f}.ndjson").write_text("\n".join([*lines[:5], "", "{", "[1]", '{"id": "none"}', *lines[5:]]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = bundles.read_resource_lines(spark, str(tmp_path), F.lit("s"), F.lit("p"))
        assert df.rdd.getNumPartitions() > 4
        found = [r.id for r in df.orderBy("input_pos").collect()]
        assert found == [f"{f}-{n:04d}" for f in range(2) for n in range(900)] and df.select("input_pos").distinct().count() == 1800
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_header_is_checked(spark, tmp_path):
    (tmp_path / "a.csv").write_text('category,friendly_name,canonical_source,canonical_code\ncondition,"Cough, ""dry""",ICD10CM,R05\n')
    header = ["category", "friendly_name", "canonical_source", "canonical_code"]
    row = terminology.read_checked_csv(spark, str(tmp_path / "a.csv"), header, "category string, friendly_name string, canonical_source string, canonical_code string").first()
    assert row.friendly_name == 'Cough, "dry"'
    with pytest.raises(ValueError):
        terminology.read_checked_csv(spark, str(tmp_path / "a.csv"), ["category", "name"], "category string, name string")


def test_shards_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("loinc", "1", "A"), ("loinc", "2", "B"), ("cvx", "3", "C")], "system string, code string, name string")
    terminology.write_shards(rows, str(tmp_path / "out"))
    back = terminology.read_shard_lines(spark, str(tmp_path / "out" / "shards"))
    assert {(r.system, r.code) for r in back.collect()} == {("loinc", "1"), ("loinc", "2"), ("cvx", "3")}
    assert {r.system: r.entries for r in spark.read.json(str(tmp_path / "out" / "manifest")).collect()} == {"loinc": 2, "cvx": 1}


def test_lookback(resources):
    now = 1_779_667_200_000  # 2026-05-25
    rows = resources(
        {"resourceType": "Patient", "id": "p"}, {"resourceType": "Condition", "id": "c", "recordedDate": "2020-01-01"}, {"resourceType": "Observation", "id": "new", "effectiveDateTime": "2026-05-01"},
        {"resourceType": "Observation", "id": "old", "effectiveDateTime": "2020-05-01"}, {"resourceType": "DiagnosticReport", "id": "undated"}, {"resourceType": "Encounter", "id": "ended", "period": {"end": "2019-01-01"}},
    )
    assert {r.id for r in export.filter_lookback(rows, 365, now).collect()} == {"p", "c", "new", "undated"}
    assert export.filter_lookback(rows, None, now).count() == 6


def test_stream_state_is_idempotent(spark, tmp_path):
    schema = "k string, at int, v string"
    log = incremental.ChangeLog(spark, str(tmp_path / "log"), schema, ["k"])
    landed = str(tmp_path / "landed")

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)

    def run():
        stream = spark.readStream.schema(schema).parquet(landed)
        incremental.upsert_stream(stream, log, ["at"], str(tmp_path / "progress")).awaitTermination()
        return {r.k: r.v for r in log.latest().collect()}

    assert log.latest().count() == 0
    land([("a", 1, "first"), ("b", 5, "kept"), ("d", 1, "still")])
    assert run() == {"a": "first", "b": "kept", "d": "still"}
    land([("a", 2, "second"), ("b", 4, "late"), ("c", 1, "new")])
    assert run() == {"a": "second", "b": "kept", "c": "new", "d": "still"}
    assert run() == {"a": "second", "b": "kept", "c": "new", "d": "still"}
    # A batch only touches its own keys, and one that is replayed writes its partition again.
    assert {r.k for r in log.changes().filter("batch = 1").collect()} == {"a", "b", "c"}
    log.write(spark.createDataFrame([("a", 2, "second"), ("b", 5, "kept"), ("c", 1, "new")], schema), 1)
    assert {r.k: r.v for r in log.latest().collect()} == {"a": "second", "b": "kept", "c": "new", "d": "still"}


def test_groups_and_pending_records_after_every_batch(spark, tmp_path):
    schema = "patient_id string, record_id string, record_pos bigint, name string, bucket string, resource_type string, confidence double, fallback boolean"
    landed = str(tmp_path / "landed")
    batches = [[("p", "a", 1, "Sugar", None, "Observation", 0.4, False), ("p", "b", 2, "Cough", None, "Condition", 0.9, False)], [("p", "c", 0, "sugar", None, "Condition", 0.8, True)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
    run = incremental.NamingRun(spark, landed, schema, str(tmp_path))
    seen = []
    run.run(seen.append)
    assert seen == [0, 1]
    records = spark.createDataFrame([("p", i) for i in "abcd"], "patient_id string, id string")
    assert [sorted(r.id for r in run.pending(records, b).collect()) for b in (0, 1)] == [["c", "d"], ["d"]]
    views = [{r.name: (r.resource_types, r.confidence, r.fallback, r.n_records) for r in run.view(b).collect()} for b in (0, 1)]
    assert views[0] == {"Sugar": (["Observation"], 0.4, False, 1), "Cough": (["Condition"], 0.9, False, 1)}
    assert views[1] == {"Sugar": (["Condition", "Observation"], 0.8, True, 2), "Cough": (["Condition"], 0.9, False, 1)}


def test_naming_batch_falls_back_as_a_whole(spark):
    rows = [("b1", "r1", "Condition", "Label 1"), ("b1", "r2", "Condition", "Label 2"), ("b2", "r3", "MedicationRequest", "Metformin tablet"), ("b2", "r4", "Observation", "")]
    df = spark.createDataFrame([(*r, "Laboratory", None, [], [], []) for r in rows], "batch_id string, record_id string, resource_type string, source_label string, category string, category_code string, ingredients array<string>, code_texts array<string>, code_codings array<struct<code:string,display:string>>")
    replies = [
        ("b1", json.dumps([{"id": "r1", "patientFriendlyName": "One"}])),
        ("b2", json.dumps({"records": [{"recordId": "r3", "patientFriendlyName": "Aspirin"}, {"resourceId": "r4", "patientFriendlyName": "Sugar", "observationBucket": "LAB", "confidence": 3}, {"id": "r4", "patientFriendlyName": "Later"}]})),
    ]
    out = model_output.validate_names(df, model_output.naming_items(spark.createDataFrame(replies, "batch_id string, reply string")))
    got = {r.record_id: (r.name, r.bucket, r.confidence, r.fallback) for r in out.collect()}
    assert got == {
        "r1": ("Label 1", None, 0.45, True), "r2": ("Label 2", None, 0.45, True), "r3": ("Metformin tablet", None, 0.45, True), "r4": ("Sugar", "labs", 1.0, False),
    }


def test_every_query_has_sql_and_columns(spark):
    import __spark_entry__ as entry

    assert set(ORACLES) == set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["patient_id", "concept", "unit", "point_count", "direction", "latest", "previous", "percent_change"]


HELD = [
    "trend_detection", "friendly_names", "observation_conditions", "impact_labels", "validated_associations", "incremental_groups", "pending_after_batches", "duplicate_pair_counts", "deduplicated_counts",
    "lab_condition_edges", "medication_condition_edges", "active_groups", "filtered_observations", "overview_items", "medication_conditions", "allergy_classes", "leftover_groups",
]


@pytest.mark.parametrize("name", HELD)
def test_against_sql(spark, name):
    from oracle_check import compare

    ok, note = compare(spark, "/root/testdata/sf0.001", name, QUERIES[name], ORACLES[name])
    assert ok, note
