import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from recordloom.llm import bpe, decontamination, secrets, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, odd):
    """What goes into and comes out of each stage, with odd rows beside the given ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10_000), allowMissingColumns=True).select(*odd.columns)
    out = []
    for name, stage in C.STAGES:
        result = C.stored(stage(spark, rows, SF), name)
        out.append((rows, result))
        rows = result
    return out


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_keep_the_columns_and_only_given_rows(steps, odd):
    for before, after in steps[:4]:
        assert after.columns == odd.columns
        assert after.count() <= before.count()
    for before, after in steps[:3]:
        assert not set(by_row(after)) - set(by_row(before))
    assert steps[4][1].count() == steps[3][1].count() == steps[2][1].count()


def test_bad_quality_goes_and_good_stays(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({r.doc_id for r in df.select("doc_id").collect()} for df in steps[0])
    good, bad = ([i for i in before if labels.get(i) == q] for q in (1, 0))
    assert len([i for i in good if i in after]) / len(good) > 0.95
    assert len([i for i in bad if i in after]) / len(bad) < 0.2


def test_one_document_of_each_group_stays(steps):
    before, after = steps[1]
    rows = [(r.doc_id, simhash.fingerprint(r.text)) for r in before.collect()]
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    first = {}
    for i, p in rows:
        key = (i is None, i or 0)
        first[find(p)] = min(key, first.get(find(p), key))
    expected = sorted((None if unnamed else i for unnamed, i in first.values()), key=repr)
    assert sorted((r.doc_id for r in after.collect()), key=repr) == expected


def test_contaminated_documents_go_and_others_stay(spark, steps):
    before, after = steps[2]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    windows = {}
    for item in items:
        words = decontamination.words_of(item.text)
        size = min(10, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows.setdefault(size, set()).add(tuple(words[k : k + size]))

    def clean(text):
        words = decontamination.words_of(text)
        return not any(tuple(words[k : k + size]) in found for size, found in windows.items() for k in range(len(words) - size + 1))

    assert by_row(after) == sorted((tuple(r) for r in before.collect() if clean(r.text)), key=repr)


def test_secrets_are_masked_and_clean_texts_kept(steps):
    before, after = steps[3]
    old = {r.doc_id: r for r in before.collect()}
    for r in after.collect():
        assert not secrets.base_spans(r.text or "")
        was = old[r.doc_id]
        if was.text is None or "[SECRET]" not in (r.text or ""):
            assert (r.text, r.n_chars) == (was.text, was.n_chars)
        else:
            assert r.n_chars == len(r.text) and r.text != was.text


def test_tokens_of_every_kept_document(steps):
    before, after = steps[4]
    encoder = bpe.Encoder(bpe.read_vocabulary(bpe.vocabulary_path("word_bpe_49k.json")))
    expected = sorted(((r.doc_id, encoder.encode([r.text])[0]) for r in before.collect()), key=repr)
    assert sorted(((r.doc_id, bytes(r.ids)) for r in after.collect()), key=repr) == expected
    assert all(r.n_tokens == len(np.frombuffer(bytes(r.ids), "<u4")) for r in after.collect())


def test_empty_tables_pass_through(spark, none):
    rows = none
    for name, stage in C.STAGES:
        rows = C.stored(stage(spark, rows, SF), name)
        assert rows.count() == 0
