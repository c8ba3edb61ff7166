import math

import numpy as np
from pyspark.sql import functions as F

from recordloom.llm import toxicity as T


def plain_kernel(a, b):
    """Sum over shared letter triples in order, by definition."""

    def triples(word):
        out = {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + T.SPAN)):
                    if all(word[x].isalpha() for x in (i, j, k)):
                        key = word[i] + word[j] + word[k]
                        out[key] = out.get(key, 0) + T.DECAY ** (k - i + 1)
        return out

    x, y = triples(a), triples(b)
    dot = lambda p, q: sum(v * q.get(t, 0) for t, v in p.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def test_kernel_equals_its_definition():
    words, marks = ["stupid", "st.u.pid", "stuupid", "disgusting", "banana", "ab"], ["stupid", "disgust", "banana"]
    word, triple, value = T.triples(marks)
    columns = np.zeros((T.ALPHABET**3, len(marks)))
    norm = np.sqrt(np.bincount(word, value * value, len(marks)))
    columns[triple, word] = value / norm[word]
    rows = T.kernel_rows(words, columns)
    for w, row in zip(words[:-1], rows, strict=False):
        assert np.allclose(row, [plain_kernel(w, m) for m in marks])
    assert (rows[-1] == 0).all()
    assert rows[1, 0] > 0.5 and rows[2, 0] > 0.5 and rows[4, 0] < 0.1


def fixture(spark):
    calm = ["the river runs along the green valley again", "people walk home after the market closes to you", "music plays in the evening garden", "small boats cross the wide harbour"]
    rude = ["stupid", "moron", "scumbag", "worthless"]
    rows = []
    for n in range(400):
        parts = [calm[(n + k) % 4] + f" {'xyzuvw'[k % 6]}{n}" for k in range(6)]
        if n % 4 == 0:
            parts[n % 6] += f" you {rude[n // 4 % 4]}"
            parts[(n + 2) % 6] += f" {rude[(n // 4 + 1) % 4]} again"
        rows.append((n, ". ".join(parts), int(n % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_gapped_insults_are_found_and_clean_texts_are_not(spark):
    docs, labels = fixture(spark)
    machine = T.train(docs, labels)
    fresh = [(1, "what a st.u.pid m-o-r-o-n indeed"), (2, "the harbour is green in the evening"), (3, "you s t u p i d worthlesss thing"), (4, None), (5, "")]
    score = {r.doc_id: r.score for r in T.toxicity(spark.createDataFrame(fresh, "doc_id long, text string"), machine).collect()}
    assert score[1] > 0.5 and score[3] > 0.5
    assert score[2] < 0.2 and score[4] < 0.2 and score[4] == score[5]


def test_held_out_texts(spark):
    docs, labels = fixture(spark)
    rows = T.toxicity_report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97


def test_training_never_sees_held_out_labels(spark):
    _, labels = fixture(spark)
    assert T.training_labels(labels).where(T.held_out(F.col("doc_id"))).count() == 0
    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: sorted(map(tuple, T.training_labels(df).collect()))
    assert key(labels) == key(flipped)


def test_odd_rows_and_missing_labels(spark, odd, none):
    docs, labels = fixture(spark)
    rows = T.toxicity_report(odd.unionByName(docs, allowMissingColumns=True), labels).where("score is null or score < 0 or score > 1").count()
    assert rows == 0
    assert {r.score for r in T.toxicity_report(odd, labels.where("toxic = 0")).collect()} == {0.0}
    assert T.toxicity_report(none, labels).count() == 0
