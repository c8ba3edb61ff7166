"""Near duplicates by MinHash bands, odd sketches and a check on full shingle sets.

Documents with equal sets of word shingles are one set from the start. BANDS times BAND_ROWS MinHash samples are cut in bands; sets that
share a band are candidates (a link at 0.8 is in no band with probability 5e-8). The bottom SKETCHED samples of a set, under one hash
function, are folded into an odd sketch: a bitmap in which every sample flips one bit. The bits in which two sketches differ are
at most the samples in which they differ, and hardly fewer where likeness is high. A set of up to SKETCHED shingles
is sampled whole, so for two of them more differing bits than a ninth of both sizes rule a link out for certain; for larger
sets the bound lies MARGIN standard deviations higher. Every other pair that matters is decided on the full sets.

A pair matters while its sets are in different components. First every band gets hubs, its sets of lowest hash, and each set is checked with
the hub that it meets most often: a large group of near copies falls together in linear work. What is left apart in a band
is compared by sketches: each set outside the band's largest component with all sets of other components. Checked are, per
set, its best 4, then 16, then 64, ... such mates behind those it has tried, until no set has one left. So no pair is dropped,
pairs inside a component are never formed, and crowded bands are cut into cells of bounded size.

Results for odd input: null, empty and blank texts have an empty set, which links with nothing; with fewer than four words the
words are one shingle; a null doc_id is the smallest of a component only if it has no other; repeated rows get equal
results; other columns are not read; an empty table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import small_batches, stored
from .graphs import components

SHINGLE_WORDS, THRESHOLD_PERCENT = 4, 80
BANDS, BAND_ROWS = 32, 4
SKETCHED, BITS, MARGIN = 1024, 2048, 6.5
HUBS, FIRST_MATES = 3, 4
#: Sets of one role in one cell at most, and comparisons in one vector.
CELL_ROWS, PAIRS = 2000, 1 << 18

RANDOM = np.random.Generator(np.random.PCG64(13))
FLIPS = RANDOM.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64, endpoint=False)
FACTORS = RANDOM.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct lower-cased word shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]][: max(1, len(words) - SHINGLE_WORDS + 1)].tolist()
    ends = (ends[min(SHINGLE_WORDS, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends, strict=True)], np.uint64))


def samples(hashes: np.ndarray) -> np.ndarray:
    """The MinHash samples for the bands of a set that is not empty."""
    least = np.full(len(FLIPS), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(hashes), 256):
        np.minimum(least, ((hashes[low : low + 256, None] ^ FLIPS) * FACTORS).min(axis=0), out=least)
    return least


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, BAND_ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = mixed(key * MIX ^ rows[:, k])
    return key.view(np.int64)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """The bitmap, as words of 64 bits, of the lowest of the sorted hashes."""
    bit = (mixed(hashes[:SKETCHED]) % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(bit, minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def most_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketches of a link of sets of these sizes differ in this many bits at most."""
    shared = THRESHOLD_PERCENT / (100 + THRESHOLD_PERCENT) * (a + b)
    drawn = np.minimum(1, SKETCHED / np.maximum(a, b))  # the share of both that lies below the lower of their bounds
    common = shared * drawn
    spread = np.where(drawn < 1, np.sqrt(np.maximum(common * (1 - common / SKETCHED), SKETCHED / 10)), 0)
    return np.minimum(a, SKETCHED) + np.minimum(b, SKETCHED) - 2 * common + 2 * MARGIN * spread + 1e-6


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        keys, sizes, bands, sketches = [], [], [], []
        for text in batch["text"].to_pylist():
            hashes = shingles(text)
            least = samples(hashes) if len(hashes) else None
            keys.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
            sizes.append(len(hashes))
            bands.append(band_keys(least) if len(hashes) else None)
            sketches.append(odd_sketch(hashes) if len(hashes) else None)
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (bands, sketches)]
        yield pa.RecordBatch.from_arrays([batch["row"], batch["key"], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *lists], ["row", "key", "set", "size", "bands", "sketch"])


def shingle_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = pa.array([shingles(t).view(np.int64) for t in batch["text"].to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch["id"], batch["size"], lists], ["id", "size", "shingles"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("size").alias(f"n_{c}"), F.col("shingles").alias(f"s_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * THRESHOLD_PERCENT).where(100 * shared >= THRESHOLD_PERCENT * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def merged(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) of all linked sets once ``links`` are added to the components ``known``."""
    if known is None:
        return stored(components(links).select(F.col("node").alias("id"), F.col("root").alias("component")), "components")
    side = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    roots = stored(components(between).select(F.col("node").alias("component"), "root"), "roots")
    moved = known.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    new = roots.select(F.col("component").alias("id"), F.col("root").alias("component")).join(known.select("id"), "id", "left_anti")
    return stored(moved.union(new), "components")


def with_component(members: DataFrame, known: DataFrame) -> DataFrame:
    """``members`` with the component of ``id``."""
    return members.join(known.withColumnRenamed("component", "_c"), "id", "left").withColumn("component", F.coalesce("_c", "id")).drop("_c")


def still_mixed(members: DataFrame) -> DataFrame:
    """Members of bands that hold more than one component."""
    apart = members.groupBy("band").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high").select("band")
    return members.join(apart, "band", "left_semi")


def hub_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each set with the hub that it shares most bands with."""
    hubs = members.groupBy("band").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id"))["id"].alias("b"))
    met = members.join(hubs, "band").where(F.col("id") != F.col("b"))
    often = met.groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("n"))
    return often.groupBy("a").agg(F.max(F.struct("n", "b"))["b"].alias("b"))


def best_mates(x: dict[str, np.ndarray], y: dict[str, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, mate, differing bits) of the ``width`` best mates in ``y`` of each set in ``x`` behind its last one tried."""
    found: list[tuple[np.ndarray, ...]] = []
    step = max(1, PAIRS // max(1, len(y["id"])))
    for low in range(0, len(x["id"]), step):
        own = {k: v[low : low + step] for k, v in x.items()}
        differ = np.zeros((len(own["id"]), len(y["id"])), np.int64)
        for word in range(BITS // 64):
            differ += np.bitwise_count((own["sketch"][:, word, None] ^ y["sketch"][None, :, word]).view(np.uint64))
        ahead = (differ > own["bits"][:, None]) | ((differ == own["bits"][:, None]) & (y["id"][None, :] > own["mate"][:, None]))
        small, large = np.minimum(own["size"][:, None], y["size"]), np.maximum(own["size"][:, None], y["size"])
        ok = ahead & (differ <= most_bits(small, large)) & (own["component"][:, None] != y["component"]) & (small * 100 >= large * THRESHOLD_PERCENT)
        a, b = np.nonzero(ok)
        bits, mates = differ[a, b], y["id"][b]
        order = np.lexsort((mates, bits, a))
        a, bits, mates = a[order], bits[order], mates[order]
        at = np.arange(len(a)) - np.searchsorted(a, a)
        keep = at < width
        found.append((own["id"][a[keep]], mates[keep], bits[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def compare_cells(width: int):
    names = ("cell", "scans", "id", "component", "size", "bits", "mate")

    def mates(part: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.r_[True, part["cell"][1:] != part["cell"][:-1], True]) if len(part["cell"]) else []
        for low, high in zip(cuts, cuts[1:], strict=False):
            own = {k: v[low:high] for k, v in part.items()}
            first = own["scans"] == 1
            x, y = ({k: v[rows] for k, v in own.items()} for rows in (first, ~first))
            if len(x["id"]) and len(y["id"]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in best_mates(x, y, width)], ["a", "b", "bits"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        for batch in batches:
            new = {c: batch[c].to_numpy().astype(np.int64) for c in names}
            new["sketch"] = batch["sketch"].flatten().to_numpy().reshape(-1, BITS // 64)
            rest = new if rest is None else {k: np.concatenate([rest[k], v]) for k, v in new.items()}
            if len(rest["cell"]):
                cut = int(np.flatnonzero(np.r_[True, rest["cell"][1:] != rest["cell"][:-1]])[-1])  # the last cell may go on
                yield from mates({k: v[:cut] for k, v in rest.items()})
                rest = {k: v[cut:] for k, v in rest.items()}
        if rest is not None:
            yield from mates(rest)

    return compare


def sketch_pairs(members: DataFrame, width: int) -> DataFrame:
    """(a, b, bits): of each set that scans, its best mates of other components in its bands, ``width`` at most."""
    sizes = members.groupBy("band").agg(F.count_if("scans").alias("n_x"), F.count("*").alias("n_y")).where("n_x > 0")
    parts = sizes.select("band", *[F.ceil(F.col(c) / CELL_ROWS).cast("int").alias(c) for c in ("n_x", "n_y")])
    cut = members.join(parts, "band")
    # A band has n_x * n_y cells; its sets that scan lie in the cells of one row, and all sets in those of one column.
    part = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n).cast("long")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_x = F.when(F.col("scans"), F.transform(every("n_y"), lambda k: F.struct(part("n_x", 1).alias("x"), k.alias("y"), F.lit(1).alias("scans"))))
    as_y = F.transform(every("n_x"), lambda k: F.struct(k.alias("x"), part("n_y", 2).alias("y"), F.lit(0).alias("scans")))
    none = F.array().cast("array<struct<x:int,y:int,scans:int>>")
    cells = cut.withColumn("to", F.explode(F.concat(F.coalesce(as_x, none), as_y)))
    keyed = cells.select(F.xxhash64("band", "to.x", "to.y").alias("cell"), F.col("to.scans").alias("scans"), "id", "component", "size", "bits", "mate", "sketch")
    mates = keyed.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare_cells(width), "a long, b long, bits long").distinct()
    rank = F.row_number().over(Window.partitionBy("a").orderBy("bits", "b"))
    return mates.withColumn("_rank", rank).where(F.col("_rank") <= width).drop("_rank")


def near_components(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, component) of all linked ``sets`` (id, size, bands, sketch); ``texts`` has the (id, text) of each set."""
    banded = sets.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = stored(banded.join(shared, "band", "left_semi"), "bands")
    listed = members.select("id").distinct().join(sets.select("id", "size"), "id").join(texts, "id")
    full = stored(listed.select("id", "size", "text").mapInArrow(shingle_lists, "id long, size long, shingles array<long>"), "sets")
    first = reduce(DataFrame.union, [hub_pairs(members, turn) for turn in range(HUBS)])
    pairs = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    known = merged(None, verified(pairs, full))
    rows = stored(still_mixed(with_component(members, known)), "members")
    # Of each band the sets outside its largest component look for mates, now and in all later rounds.
    largest = rows.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "component"))["component"].alias("_main"))
    scanning = rows.join(largest, "band").withColumn("scans", F.col("component") != F.col("_main")).drop("_main")
    rows = stored(scanning.withColumn("bits", F.lit(-1).cast("long")).withColumn("mate", F.lit(-1).cast("long")), "members")
    width = FIRST_MATES
    while True:
        sketched = rows.join(sets.select("id", "size", "sketch"), "id")
        pairs = stored(sketch_pairs(sketched, width), "pairs")
        if pairs.isEmpty():
            return known
        known = merged(known, verified(pairs.select("a", "b"), full))
        # A set with a full list may have more mates; the others have tried all of theirs.
        tried = pairs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"), F.max(F.struct("bits", "b")).alias("last")).where(F.col("n") == width)
        moved = rows.drop("bits", "mate", "component").join(tried, "id", "left")
        on = moved.select("id", "band", (F.col("scans") & F.col("last").isNotNull()).alias("scans"), F.coalesce("last.bits", F.lit(-1)).alias("bits"), F.coalesce("last.b", F.lit(-1)).alias("mate"))
        rows = stored(still_mixed(with_component(on, known)), "members")
        width *= 4


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, component_id) for each row: the size of its shingle set and the smallest key that its links reach."""
    small_batches(docs.sparkSession)
    rows = stored(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row")), "texts")
    kind = rows.schema["key"].dataType.simpleString()
    signed = stored(rows.select("row", "key", "text").mapInArrow(signatures, f"row long, key {kind}, set binary, size long, bands array<long>, sketch array<long>"), "signatures")
    known = signed.where("set IS NOT NULL")
    distinct = stored(known.groupBy("set").agg(F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key")).alias("least"), F.min("row").alias("id")), "distinct")
    sets = stored(distinct.join(signed.select(F.col("row").alias("id"), "size", "bands", "sketch"), "id").select("id", "size", "bands", "sketch"), "distinct")
    known = near_components(sets, rows.select(F.col("row").alias("id"), "text"))
    joined = distinct.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = joined.groupBy("component").agg(F.min("least")["key"].alias("component_id"))
    by_set = joined.join(least, "component").select("set", "component_id", F.lit(True).alias("known"))
    found = signed.select("key", "set", "size").join(by_set, "set", "left")
    return found.select(F.col("key").alias(key), "size", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def duplicates_report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
