import hashlib
import re

from recordloom.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    for doc_id, text in texts:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if ids := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= ids
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_report_equals_brute_force(spark, docs, texts, same):
    rows = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows += [(7001, "One TWO three four five six seven eight nine ten eleven"), (7002, "日本語"), (7003, ""), (7004, None), (None, "word"), (7001, "lazy dog")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    same(D.contamination_report(docs, items), columns, brute(texts, rows))


def test_segments_in_batches_and_empty_tables(spark, docs, none, same, monkeypatch):
    items = spark.createDataFrame([(1, "the lazy dog"), (2, "seven eight nine"), (3, "word")], "item_id long, text string")
    whole = D.contamination_report(docs, items).collect()
    monkeypatch.setattr(D, "BATCH_BYTES", 40)
    same(D.contamination_report(docs.repartition(5), items), ["*"], whole)
    assert D.contamination_report(none, items).count() == 0
    assert D.contamination_report(docs, items.where("false")).where("contaminated").count() == 0


def test_lists_of_a_segment_hold_every_place():
    texts = ["b a b", None, "a c", ""]
    lengths, terms, counts, places = D.segment_lists(texts)
    assert lengths == [3, 0, 2, 0]
    rows = [r for batch in D.list_batches("s", terms, counts, places) for r in zip(*(c.to_pylist() for c in batch), strict=True)]
    assert {t: (n, list(memoryview(p).cast("i"))) for _, t, n, p in rows} == {"b": (2, [0, 2]), "a": (2, [1, 5]), "c": (1, [6])}


def test_an_item_in_every_document_and_many_windows(spark, same):
    """One passage stands in a third of all documents, and one item has thousands of windows."""
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(n, f"x{n} {passage} y{n}" if n % 3 == 0 else f"z{n} w{n % 7}") for n in range(300)]
    items = [(1, passage), (2, " ".join(f"q{k}" for k in range(3000)))]
    report = D.contamination_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"))
    same(report, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], brute(rows, items))


def test_proximity_stays_in_a_document(spark):
    docs = spark.createDataFrame([(1, "alpha beta x gamma"), (2, "alpha beta"), (3, "gamma"), (4, "alpha y beta z z z gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    hits = lambda slop: {r.doc_id: r.n_hit for r in D.contamination(docs.coalesce(1), items, slop=slop).collect()}
    assert hits(0) == {1: 0, 2: 0, 3: 0, 4: 0}
    assert hits(1) == {1: 4, 2: 0, 3: 0, 4: 0}
    assert hits(4) == {1: 4, 2: 0, 3: 0, 4: 7}
