"""Near duplicates by SimHash, found by anchor-point covering.

Two fingerprints of 64 bits that differ in at most 4 bits differ in at most one bit of one of three blocks (21, 21 and 22
bits). The anchors of a block are the words of a covering code: the perfect Hamming code on 15 of its bits, whose covering
radius is 1, and every word on the other bits. A fingerprint has its home at the nearest anchor and visits each anchor within
covering radius plus threshold that can be the home of a fingerprint one bit away. At every anchor the fingerprints at home
are compared with all that are there. What an anchor reports is a forest, never all pairs: each fingerprint and the smallest
one that its links reach there. Anchors with many fingerprints are cut into cells of bounded size that meet pairwise.

Equal fingerprints are one row from the start, so copies cost nothing. Results for odd input: a null or empty text has the
fingerprint zero, linked like any other; a null id is never the smallest unless its group has no other; repeated rows get
equal results; other columns are not read; an empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, stored
from .graphs import components

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: First bit and width of each block; the code lies on its lowest 15 bits.
BLOCKS = ((0, 21), (21, 21), (42, 22))
CODED = 15
#: Fingerprints of one role in one cell at most.
CELL_ROWS = 2000
#: Comparisons in one vector at most.
PAIRS = 1 << 21

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """SimHash of the lower-cased word shingles, repeats included, as a signed 64-bit integer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (np.r_[0, ends[:-1]][: max(1, len(words) - SHINGLE_WORDS + 1)]).tolist()
    ends = (ends[min(SHINGLE_WORDS, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)
    by_byte = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(0, 2048, 256)
    counts = np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits((counts * 2 > len(hashes)).ravel(), bitorder="little").view(np.int64)[0])


def fingerprint_column():
    """A column function: the fingerprint of a text."""

    def hash_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(t.as_py()) for t in batch], pa.int64())

    hash_texts.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(hash_texts, "long")


def nearest_codeword() -> np.ndarray:
    """For each word of 15 bits the codeword at distance 0 or 1: the syndrome names the bit to flip."""
    words = np.arange(1 << CODED)
    syndrome = np.zeros(len(words), np.int64)
    for bit in range(CODED):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
    return np.where(syndrome > 0, words ^ (1 << np.maximum(syndrome - 1, 0)), words)


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, anchor key) of all memberships; a key is twice the anchor's number, odd for visits."""
    codeword = nearest_codeword()
    who, keys = [], []
    every = np.arange(len(prints))
    for n, (first, width) in enumerate(BLOCKS):
        block = (prints.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
        coded, raw = block & ((1 << CODED) - 1), block >> CODED << CODED
        home = codeword[coded]
        found = np.sort(np.stack([codeword[coded ^ (1 << bit)] for bit in range(CODED)]), axis=0)
        new = (np.r_[[np.full(len(prints), -1)], found[:-1]] != found) & (found != home)
        which, at = np.nonzero(new)
        places = [(every, (home | raw) * 2), (at, (found[which, at] | raw[at]) * 2 + 1)]
        places += [(every, (home | raw ^ (1 << bit)) * 2 + 1) for bit in range(CODED, width)]
        for at, key in places:
            who.append(at)
            keys.append(key + (n << 24))
    return np.concatenate(who), np.concatenate(keys)


def spread_to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch["fp"].to_numpy()
        if len(prints):
            who, keys = anchors(prints)
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array((keys & 1).astype(np.int32)), pa.array(prints[who])], ["anchor", "visit", "fp"])


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        old = root.copy()
        for side in (a, b):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        root = root[root]
        if (root == old).all():
            break
    return root


def cell_links(cell: np.ndarray, visit: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints with the smallest one they reach in their cell. Rows come sorted by cell, those at home first.

    Every pair of one at home and one of the cell is compared, in vectors of bounded length; links found so far are reduced
    to roots before the next vector.
    """
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    homes = np.add.reduceat((visit == 0).astype(np.int64), starts)
    first = np.repeat(starts, sizes)
    width = np.repeat(homes, sizes)  # row r is compared with the rows first[r] .. first[r] + width[r] - 1
    upto = np.cumsum(width)
    root = np.arange(len(cell))
    low = 0  # bitwise_count takes the absolute value of signed numbers, so differences are viewed as unsigned
    while low < len(cell):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, "right")))
        rows = np.repeat(np.arange(low, high), width[low:high])
        offset = np.arange(len(rows)) - np.repeat(np.r_[0, np.cumsum(width[low:high])[:-1]], width[low:high])
        mates = first[rows] + offset
        near = np.bitwise_count((prints[rows] ^ prints[mates]).view(np.uint64)) <= max_bits
        near &= rows != mates
        if near.any():
            held = np.flatnonzero(root != np.arange(len(cell)))
            root = local_roots(len(cell), np.r_[rows[near], held], np.r_[mates[near], root[held]])
        low = high
    hung = np.flatnonzero(prints[root] != prints)  # in cut cells a fingerprint can stand twice
    return prints[hung], prints[root[hung]]


def compare_cells(max_bits: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)]

        def links(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(part[0]):
                a, b = cell_links(*part, max_bits)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            rest = [np.concatenate([old, batch[name].to_numpy().astype(np.int64)]) for old, name in zip(rest, ("cell", "visit", "fp"), strict=True)]
            if len(rest[0]):
                cut = int(np.flatnonzero(np.r_[True, rest[0][1:] != rest[0][:-1]])[-1])  # the last cell may go on
                yield from links([x[:cut] for x in rest])
                rest = [x[cut:] for x in rest]
        yield from links(rest)

    return compare


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links whose components are those of all pairs of ``prints.fp`` that differ in at most ``max_bits`` (up to 4) bits."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the blocks cover up to 4 differing bits")
    members = prints.select("fp").mapInArrow(spread_to_anchors, "anchor long, visit int, fp long")
    crowded = members.groupBy("anchor").agg(F.sum(1 - F.col("visit")).alias("homes"), F.sum("visit").alias("visits")).where((F.col("homes") > CELL_ROWS) | (F.col("visits") > CELL_ROWS) & (F.col("homes") > 0))
    parts = crowded.select("anchor", F.ceil(F.col("homes") / CELL_ROWS).cast("int").alias("n_homes"), F.ceil((F.col("homes") + F.col("visits")) / CELL_ROWS).cast("int").alias("n_all"))
    cut = members.join(parts, "anchor", "left")
    # Of a crowded anchor, those at home lie in n_homes parts and all in n_all parts; a cell is one part of each.
    part = lambda n, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.coalesce(F.col(n), F.lit(1)).cast("long")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1)
    own_home, own_all = part("n_homes", 1), part("n_all", 2)
    as_home = F.when(F.col("visit") == 0, F.transform(every("n_all"), lambda k: F.struct(own_home.alias("home"), k.alias("all"), F.lit(0).alias("visit"))))
    as_other = F.when((F.col("visit") == 1) | F.col("n_all").isNotNull(), F.transform(every("n_homes"), lambda k: F.struct(k.alias("home"), own_all.alias("all"), F.lit(1).alias("visit"))))
    none = F.array().cast("array<struct<home:int,all:int,visit:int>>")
    cells = cut.select("anchor", "fp", F.explode(F.concat(F.coalesce(as_home, none), F.coalesce(as_other, none))).alias("to"))
    keyed = cells.select(F.when((F.col("to.home") > 0) | (F.col("to.all") > 0), F.xxhash64("anchor", "to.home", "to.all")).otherwise(F.col("anchor")).alias("cell"), F.col("to.visit").alias("visit"), "fp")
    return keyed.repartition("cell").sortWithinPartitions("cell", "visit").mapInArrow(compare_cells(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fp, component_id) for each row: its fingerprint and the smallest key that its links reach."""
    small_batches(docs.sparkSession)
    rows = stored(docs.select(F.col(key).alias("key"), fingerprint_column()(F.col(text).cast("string")).alias("fp")), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("key").alias("least"))
    roots = components(near_links(prints, max_bits)).withColumnRenamed("node", "fp")
    joined = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = joined.join(least, "root").select("fp", "component_id")
    return rows.join(by_print, "fp").select(F.col("key").alias(key), "fp", "component_id")


def duplicates_report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
