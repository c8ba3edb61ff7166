"""Plans of operators whose inputs or results grow large, and the odd rows that their shortcuts must still get right."""

import re

from pyspark.sql import functions as F

from recordloom.functions.ranking import slots_of
from recordloom.operators import bm25, builds, classify, relationships, terminology
from recordloom.plans import catalog
from recordloom.session import once
from recordloom.sources import export
from recordloom.streaming import incremental


def bm25_stem(word):
    return re.sub(bm25.suffix_pattern(), r"\1", word)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_export_does_not_broadcast_the_records(spark, resources):
    rows = resources({"resourceType": "Encounter", "id": "e1"}, {"resourceType": "Encounter", "id": "e2"})
    patches = spark.createDataFrame(
        [("p1", "Encounter", "e1", "a", "f", "v", "2020"), ("p1", "Encounter", "gone", "b", "f", "v", "2020")],
        "patient_id string, target_type string, target_id string, patch_id string, field string, value string, authored_at string",
    )
    entries = export.collection_entries(rows, patches)
    assert "Broadcast" not in plan_of(entries)
    assert sorted(r.full_url for r in entries.collect()) == ["Encounter/e1", "Encounter/e2", "PatientPatch/a"]


def test_pairs_by_name_are_unique_without_an_exchange_of_all_pairs(spark):
    meds = spark.createDataFrame([("p", "m1", "Gout"), ("p", "m1", "gout"), ("p", "m1", "Acne"), ("p", "m2", "GOUT"), ("q", "m3", "gout")], "patient_id string, medication_group string, condition_name string")
    groups = spark.createDataFrame([("p", "c1", "gout"), ("p", "c1", "acne"), ("p", "c2", "Gout"), ("p", "c2", None), ("q", "c1", "acne"), ("q", "c4", None)], "patient_id string, group_key string, name string")
    found = relationships.related_by_name(meds, groups)
    got = sorted((r.patient_id, r.medication_group, r.condition_group) for r in found.collect())
    assert got == [("p", "m1", "c1"), ("p", "m1", "c2"), ("p", "m2", "c1"), ("p", "m2", "c2")]
    plan = plan_of(found)  # only pairs of groups with several names are made distinct after the join
    assert plan.index("Union") < plan.index("keys=[patient_id#") and "HashAggregate" not in plan[: plan.index("Union")]


def test_lab_strengths_of_several_codes(spark):
    labs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "c"), (4, None)], "k int, code string")
    assoc = spark.createDataFrame([("x", "a", "weak", 5), ("x", "a", "strong", 2), ("x", "b", "moderate", 1), ("y", "b", "weak", 9), ("z", "d", "weak", 1)], "condition_code string, code string, strength string, pos int")
    got = sorted(tuple(r) for r in terminology.lab_conditions(labs, assoc, ["k"]).collect())
    assert got == [(1, "x", "strong"), (2, "x", "moderate"), (2, "y", "weak")]


def test_lab_conditions_keep_every_supplier_of_a_brand(spark):
    query, sf = catalog.QUERIES["lab_conditions"], "/root/testdata/sf0.001"
    part, items = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("part", "lineitem"))
    brands = items.join(part, items["l_partkey"] == part["p_partkey"]).select("l_suppkey", "p_brand").distinct()
    assert query(spark, sf).count() == part.join(brands, "p_brand").count()


def test_medications_of_equal_ingredients_share_their_conditions(spark):
    meds = spark.createDataFrame([(1, "p1", []), (2, "p2", []), (3, "b", []), (4, "p1", ["b", "b"]), (5, "none", []), (6, "p1", ["a"]), (6, "b", [])], "k int, code string, given array<string>")
    ingredients = spark.createDataFrame([("p1", "a"), ("p1", "b"), ("p2", "b"), ("p2", "a")], "product_code string, ingredient_code string")
    assoc = spark.createDataFrame([("x", "a", "weak", 4), ("x", "b", "strong", 7), ("y", "b", "moderate", 2)], "condition_code string, code string, strength string, condition_pos int")
    found = terminology.medication_conditions(meds, ingredients, assoc, ["k"])
    both, b = {("x", "strong", 4), ("y", "moderate", 2)}, {("x", "strong", 7), ("y", "moderate", 2)}
    want = {1: both, 2: both, 3: b, 4: b, 6: both}
    assert sorted(tuple(r) for r in found.collect()) == sorted((k, *row) for k, rows in want.items() for row in rows)
    plan = plan_of(found)  # sets are joined to their members after the last aggregate
    assert "HashAggregate" not in plan[: plan.index("Union")] and "_set" in plan


def test_hits_of_labels_carry_no_text(spark):
    corpus = spark.createDataFrame([("lab", n, f"serum glucose {w}", f"Name {n}", "", str(n), "loinc") for n, w in enumerate(["fasting", "random", "tolerance"])], "category string, rid int, text string, name string, friendly_name string, code string, system string")
    index = bm25.build_index(corpus.select("category", "rid", "text"))
    index["postings"] = index["postings"].withColumn("impact", F.col("impact") + 5)
    label = "tolerance test of " + "a very long label " * 20
    rows = spark.createDataFrame([(1, "Observation", label, [], []), (2, "Observation", label, [], []), (3, "Observation", "nothing known", [], [])], "k int, resource_type string, source_label string, code_texts array<string>, code_codings array<struct<code:string,display:string>>")
    found = bm25.name_records(rows, index, corpus, ["k"])
    assert sorted((r.k, r.friendly) for r in found.collect()) == [(1, "Name 2"), (2, "Name 2")]
    numbered = [line for line in plan_of(found).splitlines() if "WindowGroupLimit" in line]
    assert numbered and all("qid#" in line and "L" in line.split("qid#")[1].split(",")[0] for line in numbered)  # a long, not the label


def test_name_tiers_of_medications_with_several_names_and_codes(spark):
    meds = spark.createDataFrame([(1, "Zinc"), (2, "x iron"), (2, "Zinc / Iron"), (3, "old iron pill"), (4, "Zinc"), (4, "Zinc"), (5, "none"), (6, "big zinc"), (6, "iron mix"), (7, None)], "k int, name string")
    codes = spark.createDataFrame([(1, "a"), (1, "b"), (3, "none"), (4, "none"), (8, "a")], "k int, code string")
    products = spark.createDataFrame([("a", "Iron"), ("b", "IRON"), ("b", "Zinc")], "product_code string, ingredient_name string")
    pairs = spark.createDataFrame([("Anemia", "iron"), ("Anemia", "zinc"), ("Colds", "Zinc")], "condition_name string, related_name string")
    found = terminology.medication_name_conditions(meds, codes, products, pairs, ["k"])
    want = [(1, "Anemia", 1), (1, "Colds", 1), (2, "Anemia", 2), (2, "Colds", 2), (3, "Anemia", 3), (4, "Anemia", 2), (4, "Colds", 2), (6, "Anemia", 3), (6, "Colds", 3), (8, "Anemia", 1)]
    assert sorted(tuple(r) for r in found.collect()) == want
    plan = plan_of(found)  # the first branch, of medications with one code, makes nothing distinct after its join
    assert "HashAggregate" not in plan[: plan.index("Join")]


def test_lab_codes_are_picked_before_the_labs_are_joined(spark):
    labs = spark.createDataFrame([(n, "a") for n in range(5)], "k int, code string")
    assoc = spark.createDataFrame([("x", "a", "strong", n) for n in range(9)], "condition_code string, code string, strength string, pos int")
    found = terminology.lab_conditions(labs, assoc, ["k"])
    assert found.count() == 5
    plan = plan_of(found)
    assert plan.index("Union") < plan.index("min_by(")


def test_allergies_are_classified_once_and_after_the_spread(spark):
    rows = [(1, "p", True, "specific_allergy", "food"), (2, "p", True, "negative_assertion", "generic"), (3, "p", True, "negative_assertion", "food"), (4, "p", False, "negative_assertion", "drug"), (5, "q", False, "specific_allergy", "food"),
            (6, "q", True, "negative_assertion", "generic"), (7, "q", True, "negative_assertion", "food"), (8, "r", True, "specific_allergy", None), (9, "r", True, "negative_assertion", "generic"), (10, "p", True, "negative_assertion", "unknown"), (11, "s", True, "specific_allergy", "generic"), (12, "s", None, "negative_assertion", "generic")]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(label):
        seen.add(1)
        return label

    table = spark.createDataFrame(rows, "k int, patient_id string, active boolean, label string, domain string")
    found = classify.superseded_negatives(once(table, "label", noted(F.col("label"))))
    assert sorted(r.k for r in found.collect()) == [2, 3, 9, 12] and seen.value == len(rows)
    plan = plan_of(catalog.QUERIES["active_allergy_domains"](spark, "/root/testdata/sf0.001"))
    assert "RLIKE" in plan and "RLIKE" not in "".join(line for line in plan.splitlines() if "Filter" in line)


def test_subjects_of_one_code_share_its_match(spark):
    found = spark.createDataFrame([("p", "a", "E11"), ("p", "a", "E11"), ("p", "b", "E11"), ("p", "b", "Gout"), ("q", "a", "E11"), ("q", "a", "none")], "patient_id string, source_group string, condition_code string")
    groups = spark.createDataFrame([("p", "c1", 2, "E11.9", "x"), ("p", "c2", 1, "E11", "gout"), ("q", "c3", 1, "E11.9", "y")], "patient_id string, group_key string, group_pos int, code string, name string")
    edges = relationships.group_condition_edges(found, groups, "Observation", "r", "m", 1, 0)
    got = sorted((r.patient_id, r.source_group, r.target_group) for r in edges.collect())
    assert got == [("p", "a", "c2"), ("p", "b", "c2"), ("q", "a", "c3")]
    matched = relationships.match_conditions(found, groups, ["source_group"])
    assert sum(r.source_group == "a" and r.patient_id == "p" for r in matched.collect()) == 1
    assert not [line for line in plan_of(edges).splitlines() if "Generate explode" in line and "source_group" in line]


def test_codes_of_one_cell_are_distinct_without_an_exchange(spark):
    cells = spark.createDataFrame([(1, "A01-A02, A01; A02-A02"), (2, "B10-C01,b10"), (3, "A01"), (3, "A01-A01"), (None, "A05"), (None, "A05, A06"), (4, None), (5, "A09-A07, x")], "k int, codes string")
    found = builds.expand_code_ranges(cells, ["k"])
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    one = {(1, "A01"), (1, "A02"), *((1, f"A01.{d}") for d in range(10)), (1, "A02.0"), (2, "B10"), (2, "C01"), (3, "A01"), (3, "A01.0"), (None, "A05"), (None, "A06")}
    assert set(got) == one
    plan = plan_of(found)
    assert "HashAggregate" not in plan[plan.index("Union") : plan.index("Generate")] and "SortAggregate" not in plan[plan.index("Union") : plan.index("Generate")]


def test_texts_are_exchanged_once_for_their_terms(spark):
    texts = spark.createDataFrame([("lab", 1, "tests tested Tests the"), ("lab", 2, None), ("lab", 1, "test")], "category string, rid int, text string")
    counted = bm25.term_counts(texts, ["category", "rid"], "text", "tf")
    assert [tuple(r) for r in counted.collect()] == [("lab", 1, "test", 4)]
    assert plan_of(bm25.term_counts(texts, ["category", "rid"], "text", "tf")).count("Exchange hashpartitioning") == 1


def test_resources_are_read_once_for_their_edges(spark, resources):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(rid):
        seen.add(1)
        return rid

    ref = lambda r: {"reference": r}
    rows = resources(
        {"resourceType": "Observation", "id": "o1", "encounter": ref("Encounter/e1"), "derivedFrom": [ref("Observation/o1"), ref("Observation/gone"), ref("#x")]},
        {"resourceType": "Encounter", "id": "e1", "reasonReference": [ref("Condition/c1"), ref("Condition/c1")]}, {"resourceType": "Condition", "id": "c1"}, {"resourceType": "Condition", "id": " "},
    )
    edges = relationships.explicit_edges(once(rows, "id", noted(F.col("id"))))
    assert sorted((r.src, r.dst, r.kind) for r in edges.collect()) == [("Encounter/s1:e1", "Condition/s1:c1", "reason"), ("Observation/s1:o1", "Encounter/s1:e1", "encounter")]
    assert seen.value == 4
    ends = relationships.adjacency(edges)
    assert sorted((r.record_key, r.related_key, r.kind) for r in ends.collect()) == [
        ("Condition/s1:c1", "Encounter/s1:e1", "reason"), ("Encounter/s1:e1", "Condition/s1:c1", "reason"), ("Encounter/s1:e1", "Observation/s1:o1", "encounter"), ("Observation/s1:o1", "Encounter/s1:e1", "encounter"),
    ]
    assert "Union" not in plan_of(ends)


def test_pending_after_batches_needs_one_join(spark, tmp_path):
    (tmp_path / "landed").mkdir()
    run = incremental.NamingRun(spark, str(tmp_path / "landed"), "patient_id string, record_id string, name string", str(tmp_path))
    spark.createDataFrame([("p", "a"), ("p", "b")], "patient_id string, record_id string").write.parquet(f"{run.named.path}/batch=0")
    spark.createDataFrame([("p", "b"), ("p", "c"), ("q", "a")], "patient_id string, record_id string").write.parquet(f"{run.named.path}/batch=2")
    records = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), ("q", "a"), ("q", "z"), ("q", "z")], "patient_id string, id string")
    after = run.pending_after(records, 4)
    got = sorted((r.batch, r.patient_id, r.id) for r in after.collect())
    assert got == sorted((b, r.patient_id, r.id) for b in range(4) for r in run.pending(records, b).collect())
    assert sum("Join" in line for line in plan_of(run.pending_after(records, 4)).splitlines()) == 1


def test_equal_concepts_are_named_once(spark):
    fields = "id int, resource_type string, coding_keys array<string>, ingredients array<string>, source_label string, code_texts array<string>, code_codings array<struct<code:string,display:string>>"
    meds = lambda i, words, parts: (i, "MedicationRequest", ["rxnorm:1", "rxnorm:2"], parts, words, [], None)
    rows = [meds(1, "big ring", []), meds(2, "big ring", []), meds(3, "big ring", None), meds(4, "wide nut", []), meds(5, "big ring", ["wide"]), meds(6, "none", [])]
    rows += [(7, "Condition", ["icd10:E1"], [], "a", [], []), (8, "Condition", ["icd10:E1"], ["b"], None, None, []), (9, "Condition", ["icd10:E1", None], [], "a", [], []), (10, "Condition", None, [], "a", [], []), (11, None, ["icd10:E1"], [], "a", [], [])]
    terms = spark.createDataFrame(
        [("rxnorm", "1", "Ring", "exact", "IN"), ("rxnorm", "2", "Wide nut", "exact", "SCD"), ("icd10cm", "E1", "--", "exact", None)], "system string, code string, name string, match_type string, tty string"
    ).withColumns({"canonical_system": F.lit(None).cast("string"), "canonical_code": F.lit(None).cast("string")})
    found = terminology.friendly_names(spark.createDataFrame(rows, fields), terms, ["id"])
    got = {r.id: (r.resource_type, r.code, r.confidence, r.fallback) for r in found.collect()}
    ring, nut, coded = ("MedicationRequest", "1", 0.96, False), ("MedicationRequest", "2", 0.96, False), ("Condition", "E1", 0.5, True)
    assert got == {1: ring, 2: ring, 3: ring, 4: nut, 5: nut, 7: coded, 8: coded, 9: coded, 11: (None, "E1", 0.5, True)}
    plan = plan_of(found)  # entries are ranked per distinct content, and the ids take no part in it
    assert "windowspecdefinition(_concept" in plan and "windowspecdefinition(id" not in plan


def test_sets_of_ingredients_are_exchanged_as_hashes(spark):
    groups = spark.range(20).select(F.col("id").alias("k"), F.concat(F.lit("none"), "id").alias("code"), F.transform(F.sequence(F.lit(0), F.lit(99)), lambda n: F.concat(F.lit("part-"), (n + F.col("id")).cast("string"))).alias("given"))
    none = spark.createDataFrame([], "product_code string, ingredient_code string")
    assoc = spark.range(200).select(F.concat(F.lit("part-"), "id").alias("code"), F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("condition_code"), F.lit("strong").alias("strength"), F.col("id").alias("condition_pos"))
    found = terminology.medication_conditions(groups, none, assoc, ["k"])
    assert sorted((r.k, r.condition_code) for r in found.collect()) == sorted((k, f"c{c}") for k in range(20) for c in range(7))
    opened = [line for line in plan_of(found).splitlines() if "explode(_parts#" in line]
    assert opened and not [line for line in opened if line.count("_parts#") > 1]  # no row of one ingredient carries its whole set


def test_conditions_of_few_medications_are_not_repeated(spark):
    meds = spark.range(40).select(F.col("id").alias("k"), F.lit("none").alias("code"), F.array(F.lit("a"), F.lit("b")).alias("given"))
    none = spark.createDataFrame([], "product_code string, ingredient_code string")
    assoc = spark.range(30).select(F.lit("a").alias("code"), F.concat(F.lit("c"), "id").alias("condition_code"), F.lit("strong").alias("strength"), F.col("id").alias("condition_pos"))
    found = terminology.medication_conditions(meds, none, assoc, ["k"])
    assert "sequence(0, (" in plan_of(found)  # as many slots as the set's medications need
    assert found.count() == 40 * 30 and found.select("k").distinct().count() == 40
    asked = spark.createDataFrame([(1,), (4096,), (4097,), (10**9,)], "n bigint")
    assert [r[0] for r in asked.select(slots_of(F.col("n"))).collect()] == [1, 1, 2, 16]


def test_search_exchanges_no_pairs_of_query_and_record(spark):
    words = ["serum", "glucose", "fasting", "urine", "sodium", "panel", "rapid"]
    docs = [("lab", f"r{n:02}", " ".join(words[i] for i in range(7) if (n % 16) >> (i % 4) & 1)) for n in range(48)]
    index = bm25.build_index(spark.createDataFrame(docs, "category string, rid string, text string"))
    index["postings"] = index["postings"].withColumn("impact", F.col("tf").cast("double"))  # many equal scores
    asked = [("lab", n, " ".join(words[: n + 1] + words[:1])) for n in range(7)] + [("lab", 7, "unknown"), ("lab", 8, None), (None, 9, "serum"), ("drug", 10, "serum")]
    found = bm25.search(spark.createDataFrame(asked, "category string, qid int, query string"), index["postings"], 3, 2)
    tf = {(r.rid, r.term): r.impact for r in index["postings"].collect()}
    want = []
    for category, qid, query in asked:
        terms = [bm25_stem(w) for w in (query or "").split()] if category == "lab" else []
        scores = {rid: sum(tf.get((rid, t), 0) for t in terms) for _, rid, _ in docs}
        best = sorted((-s, rid) for rid, s in scores.items() if s)[:3]
        want += [(qid, rank, rid, -s) for rank, (s, rid) in enumerate(best, 1)]
    assert sorted((r.qid, r["rank"], r.rid, r.score) for r in found.collect()) == want
    below = plan_of(found).split("FlatMapCoGroups")
    assert len(below) > 1 and "SortMergeJoin" not in "".join(below) and "HashAggregate" not in below[0]


def test_a_large_result_of_small_inputs_is_joined_by_many_tasks(spark):
    labs = spark.range(500).select(F.col("id").alias("k"), F.lit("a").alias("code"))
    assoc = spark.range(300).select(F.concat(F.lit("c"), "id").alias("condition_code"), F.lit("a").alias("code"), F.lit("weak").alias("strength"), F.col("id").alias("pos"))
    found = terminology.lab_conditions(labs, assoc, ["k"])
    sizes = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 500 * 300 and len(sizes) > 4 and max(sizes) < sum(sizes) / 2


def test_medications_are_never_broadcast(spark):
    plan = plan_of(catalog.QUERIES["medication_table"](spark, "/root/testdata/sf0.001"))
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    unified = plan_of(catalog.QUERIES["unified_records"](spark, "/root/testdata/sf0.001"))
    assert unified.count("SortMergeJoin") == 1  # named providers are few: their broadcast stays
