"""Document fingerprints: threshold-scaled sketches of word shingles, with built-in functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so the sketch of a union is the union of sketches
and the share of one sketch found in another estimates containment, however unequal the documents. A sketch also keeps the
``least`` lowest hashes, whatever the threshold, so a text with fewer shingles than that is kept whole. Two sketches are compared
below the smaller of their bounds, where both are complete, and by one rule whatever their sizes. So the likeness of two texts that
are kept whole is exact; of a short text and a long one it rests on the hashes of the short one that lie below the long one's bound,
and is 0 where none does.

Results for odd input: a null text counts as empty; texts of fewer than five words are one shingle; of two empty sketches the
likeness is 1, of an empty and another 0; documents follow each other by descending doc_id, null ids last and ties by a hash of
the text; equal rows stand beside each other; one document alone follows itself; other columns are not read; an empty table
gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

SHINGLE_WORDS = 5
FRACTION = 1 / 8
#: Hashes that the registered query keeps of any text.
LEAST = 64
#: Documents per bucket of neighbours, and buckets at most: their bounds pass through the driver.
BUCKET_ROWS, BUCKETS = 2000, 1 << 16
LOWEST = -(1 << 63)


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def shingles(text: Column) -> Column:
    """Hashes of all shingles, as numbers that order like the unsigned hashes."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    numbers = F.transform(words, lambda w: F.xxhash64(w))

    def hashes(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(n) - (SHINGLE_WORDS - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(n, i, SHINGLE_WORDS)).bitwiseXOR(F.lit(LOWEST)))

    return once(numbers, lambda n: F.when(F.size(n) > 0, hashes(n)).otherwise(F.array().cast("array<long>")))


def sketch(text: Column, fraction: float = FRACTION, least: int = 1) -> Column:
    """Sorted distinct hashes below the threshold, and the ``least`` lowest ones in any case."""
    limit = LOWEST + int(fraction * (1 << 64))

    def kept(all_hashes: Column) -> Column:
        low = F.array_distinct(F.filter(all_hashes, lambda h: h < F.lit(limit)))
        return once(low, lambda found: F.when(F.size(found) >= least, F.sort_array(found)).otherwise(F.slice(F.sort_array(F.array_distinct(all_hashes)), 1, least)))

    return once(shingles(text), kept)


def merged(a: Column, b: Column, fraction: float = FRACTION, least: int = 1) -> Column:
    """The sketch of both texts' shingles together."""
    limit = LOWEST + int(fraction * (1 << 64))

    def kept(both: Column) -> Column:
        low = F.filter(both, lambda h: h < F.lit(limit))
        return F.when(F.size(low) >= least, low).otherwise(F.slice(both, 1, least))

    return once(F.sort_array(F.array_union(a, b)), kept)


def containment(a: Column, b: Column, fraction: float = FRACTION, least: int = 1) -> Column:
    """Estimated share of the smaller text's shingles that the other has."""
    limit = LOWEST + int(fraction * (1 << 64))

    def bound(s: Column) -> Column:
        return F.when(F.size(s) < least, F.lit(-LOWEST - 1)).otherwise(F.greatest(F.lit(limit - 1), F.try_element_at(s, F.lit(-1))))

    def below(s: Column, shared: Column) -> Column:
        return F.when(F.try_element_at(s, F.lit(-1)) > shared, F.filter(s, lambda h: h <= shared)).otherwise(s)

    def share(x: Column, y: Column) -> Column:
        smaller = F.least(F.size(x), F.size(y))
        return F.when(smaller == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / smaller)

    pair = once(F.least(bound(a), bound(b)), lambda shared: F.struct(below(a, shared).alias("a"), below(b, shared).alias("b")))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(once(pair, lambda p: share(p["a"], p["b"])))


def written(sketched: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(sketched, lambda h: F.lpad(F.hex(h.bitwiseXOR(F.lit(LOWEST))), 16, "0")), ""))


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the key, by a coarse and a fine search."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    coarse, fine = F.lit(bounds[::step]).cast("array<long>"), F.lit(bounds).cast("array<long>")
    skipped = F.greatest(F.size(F.filter(coarse, lambda b: b <= key)) - 1, F.lit(0)) * step
    return once(skipped, lambda s: s + F.size(F.filter(F.slice(fine, s + 1, step), lambda b: b <= key)))


def with_next(docs: DataFrame, columns: list[str], prefix: str = "next_") -> DataFrame:
    """``docs`` with ``columns`` of the next document by descending doc_id; after the last comes the first.

    Documents lie in buckets of neighbouring ids. A bucket holds its own rows and, as a guest behind them, the first row of the
    bucket that follows. The driver sees one bound and one id per bucket.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    n = max(1, min(BUCKETS, math.ceil(ids.count() / BUCKET_ROWS)))
    cuts = ids.agg(F.percentile_approx("doc_id", F.lit([k / n for k in range(1, n)]).cast("array<double>"), max(10_000, 10 * n)).alias("b")).first().b if n > 1 else []
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(bucket_of(F.col("doc_id"), sorted(set(cuts or []))))
    firsts = sorted(((r.bucket, r.first) for r in ids.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("first")).collect()), reverse=True)
    guests = spark.createDataFrame([(own, following[1]) for (own, _), following in zip(firsts, firsts[1:] + firsts[:1], strict=True)], "_bucket int, _first long")
    # A row per bucket, and so BUCKETS rows at most.
    of_guests = docs.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("_first"))).drop("_first")
    both = docs.withColumn("_bucket", bucket).withColumn("_guest", F.lit(False)).unionByName(of_guests.withColumn("_guest", F.lit(True)))
    order = Window.partitionBy("_bucket").orderBy("_guest", F.desc_nulls_last("doc_id"), "_order")
    led = both.select("*", *[F.lead(c).over(order).alias(prefix + c) for c in columns])
    return led.where(~F.col("_guest")).drop("_guest", "_bucket")


def fingerprint_report(docs: DataFrame, least: int = 1) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to it and to the next document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), sketch(text, least=least).alias("sketch"), F.xxhash64(text).alias("_order"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars") - cut), F.left("next_text", cut))
    led = with_next(rows, ["text", "sketch"]).withColumn("n_chars", F.length("text")).withColumn("edited", edited)
    out = led.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited"), least=least).alias("edited_sketch"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch"), least=least).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch"), least=least).alias("near_next"),
    )
