import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from recordloom.llm import fingerprints as P
from recordloom.llm.queries import QUERIES


def unsigned(text, least=1):
    """Hashes of the sketch: chained XXH64 of word hashes, as in the built-in function."""
    numbers = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    if not numbers:
        return []
    found = set()
    for i in range(max(1, len(numbers) - 4)):
        h = 42
        for n in numbers[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", n), h)
        found.add(h)
    low = sorted(h for h in found if h < P.FRACTION * 2**64)
    return low if len(low) >= least else sorted(found)[:least]


def near(a, b, least=1):
    """Likeness out of nothing but the two sketches."""
    bound = min(max(int(P.FRACTION * 2**64) - 1, s[-1]) if s and len(s) >= least else 2**64 for s in (a, b))
    x, y = ({h for h in s if h <= bound} for s in (a, b))
    return 1.0 if not a and not b else 0.0 if not x or not y else len(x & y) / min(len(x), len(y))


def expected_rows(texts, least):
    def order(row):
        i, t = row
        h = struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest((t or "").encode(), 42)))[0]
        return (i is None, -(i or 0), h)

    rows = sorted(texts, key=order)
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, following = t or "", following or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        own, other = unsigned(t, least), unsigned(edited, least)
        written = ["".join(f"{h:016x}" for h in s) for s in (own, other)]
        yield i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *written, near(own, other, least), near(own, unsigned(following, least), least)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("least", [1, P.LEAST])
def test_report_equals_brute_force(docs, texts, none, same, least):
    same(P.fingerprint_report(docs.repartition(3), least), COLUMNS, expected_rows(texts, least))
    assert P.fingerprint_report(none, least).count() == 0


def test_likeness_is_that_of_the_written_fingerprints(spark, same):
    """The registered query: both columns can be computed again from the fingerprint strings alone."""
    rows = QUERIES["op6_scaled_sketches"](spark, "/root/testdata/sf0.01").orderBy(F.desc("doc_id")).collect()
    parsed = [[[int(f[k : k + 16], 16) for k in range(0, len(f), 16)] for f in (r.fingerprint, r.edited_fingerprint)] for r in rows]
    for k, r in enumerate(rows):
        own, edited = parsed[k]
        assert (r.near_edited, r.near_next) == (near(own, edited, P.LEAST), near(own, parsed[(k + 1) % len(rows)][0], P.LEAST))


@pytest.mark.parametrize("rows", [1, 7, 50])
def test_next_crosses_buckets(docs, texts, rows, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", rows)
    ids = sorted({i for i, _ in texts if i is not None and i > 20}, reverse=True)
    led = P.with_next(docs.where("doc_id > 20").select("doc_id", F.lit(0).alias("_order"), F.col("doc_id").alias("name")), ["name"])
    assert {r.doc_id: r.next_name for r in led.collect()} == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_sketches_merge_and_contain(spark):
    small, large = " ".join(f"w{k}" for k in range(200)), " ".join(f"w{k}" for k in range(4000))
    row = spark.createDataFrame([(small, large)], "a string, b string").select(P.sketch(F.col("a")).alias("a"), P.sketch(F.col("b")).alias("b"))
    row = row.select(P.containment(F.col("a"), F.col("b")).alias("inside"), (P.merged(F.col("a"), F.col("b")) == F.col("b")).alias("merged"), F.size("a").alias("n")).first()
    assert row.inside == 1.0 and row.merged and row.n > 5


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_short_texts_have_exact_likeness(spark):
    texts = [" ".join(f"w{n}x{k}" for k in range(size)) for n, size in enumerate([8, 12, 20, 40, 60, 8, 12, 20, 40, 60])]
    rows = sorted(enumerate(texts), reverse=True)
    expected = {}
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(t) // 3
        own, other = shingle_set(t), shingle_set(t[: len(t) - cut] + following[:cut])
        expected[i] = len(own & other) / min(len(own), len(other))
    report = P.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string"), P.LEAST)
    assert {r.doc_id: r.near_edited for r in report.collect()} == expected and min(expected.values()) > 0


def test_short_texts_inside_long_ones(spark):
    """A short text lies wholly in a long one; that shows wherever one of its hashes is below the long one's bound."""
    words = [f"w{k}" for k in range(4000)]
    short = [" ".join(words[k * 50 : k * 50 + 5 + k % 12]) for k in range(60)]
    rows = [row for k, t in enumerate(short) for row in [(2 * k, t), (2 * k + 1, " ".join(words))]]
    report = P.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string"), P.LEAST)
    long = unsigned(" ".join(words), P.LEAST)
    told = {r.doc_id: r.near_next for r in report.collect()}
    assert all(told[2 * k] == near(unsigned(t, P.LEAST), long, P.LEAST) for k, t in enumerate(short))
    assert set(told.values()) == {0.0, 1.0}


def test_sketches_of_any_size_merge(spark):
    texts = ["", *(" ".join(f"{c}{k}" for k in range(n)) for c in "ab" for n in (1, 4, 9, 70, 300, 900))]
    rows = [(a, b) for a in texts for b in texts]
    of = lambda c: P.sketch(F.col(c), least=P.LEAST)
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", of("a").alias("sa"), of("b").alias("sb"), P.shingles(F.col("a")).alias("ha"), P.shingles(F.col("b")).alias("hb"))
    for r in df.select("*", P.merged(F.col("sa"), F.col("sb"), least=P.LEAST).alias("m"), P.containment(F.col("sa"), F.col("sb"), least=P.LEAST).alias("c")).collect():
        both = sorted({*r.ha, *r.hb})
        assert r.m == both[: max(P.LEAST, sum(h < -(1 << 63) + (1 << 61) for h in both))]
        assert r.a[:1] == r.b[:1] != "" or r.c == (1.0 if r.a == r.b else 0.0)
        assert r.a != r.b or r.c == 1.0
