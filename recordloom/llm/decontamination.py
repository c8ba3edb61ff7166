"""Benchmark decontamination over a distributed positional inverted index.

The index is a stored table. A segment is one bounded run of documents; for each of its terms there is a row with the ascending
places at which the term stands, counted through the segment with a gap between documents. Segments are built where the
documents are read, so no frequent word meets in one task. The windows of the test items are rows too. Joined counts of terms
name the rarest term of each window; the segments that have it are its candidates. Only the lists of the words of a segment's
candidate windows are moved: they meet these windows, and from the rarest on the lists, moved by their offsets, are
intersected until none or the matches are left. Nothing of the index, the items or the windows passes through the driver.

Results for odd input: null or empty texts have no words and no hits; items without an id or words are left out; an item that
occurs twice counts once; a document of no words is never contaminated; repeated rows and repeated ids give one row each;
empty tables give empty results or rows without hits; other columns are not read. Texts of any length are indexed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches, stored

WINDOW = 10
#: Text of a segment at most (or one document): its words are objects of a Python worker while it is built.
SEGMENT_BYTES = "6m"
#: Bytes of lists in one batch at most (or one list).
BATCH_BYTES = 32 << 20
#: Bytes of words stay, A-Z becomes a-z, all other ASCII becomes a space. Bytes of other characters are parts of words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "segment string, term string, n int, places binary, keys array<{}>, n_words array<int>"
HITS = "segment string, slot int, wid long, spans array<struct<start:int,end:int>>"


class Numbers(dict):
    """Numbers words in the order in which they are first seen."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def segment_lists(texts: list[str | None]) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray]:
    """Words per text, terms, postings per term, and all places term by term; one place is left free between texts."""
    numbers, codes, lengths = Numbers(), [], []
    for text in texts:
        words = words_of(text)
        codes.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        lengths.append(len(words))
    codes = np.concatenate(codes) if codes else np.empty(0, np.int32)
    places = np.arange(len(codes), dtype=np.int32) + np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    counts = np.bincount(codes, minlength=len(numbers))
    return lengths, list(numbers), counts, places[np.argsort(codes, kind="stable")].astype(np.int32)


def list_batches(segment: str, terms: list[bytes], counts: np.ndarray, places: np.ndarray) -> Iterator[tuple[pa.Array, ...]]:
    """(segment, term, n, places) of a segment in batches of bounded size."""
    ends = np.r_[0, np.cumsum(counts * 4)]
    low = 0
    while low < len(terms):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + BATCH_BYTES, "right")) - 1)
        offsets = (ends[low : high + 1] - ends[low]).astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(places[ends[low] // 4 : ends[high] // 4].tobytes())])
        yield pa.array([segment] * (high - low)), pa.array(terms[low:high], pa.binary()).cast(pa.string()), pa.array(counts[low:high].astype(np.int32)), lists
        low = high


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of all words of all rows: a row per segment and term, and one per segment with ``keys`` and words of its documents."""
    small_batches(docs.sparkSession, SEGMENT_BYTES)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    names = ["segment", "term", "n", "places", "keys", "n_words"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            segment = f"{part}-{k}"
            lengths, terms, counts, places = segment_lists(batch["text"].to_pylist())
            keys = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch["key"])
            none = [pa.nulls(1, t) for t in (pa.string(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([segment]), *none, keys, pa.array([lengths], pa.list_(pa.int32()))], names)
            for columns in list_batches(segment, terms, counts, places):
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, keys.type), pa.nulls(n, pa.list_(pa.int32()))], names)

    return stored(rows.mapInArrow(build, INDEX.format(kind)), "postings")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words): the distinct windows of every item, words joined by spaces."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                found = list(dict.fromkeys(b" ".join(words[k : k + size]) for k in range(len(words) - size + 1 if words else 0)))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary()).cast(pa.string())], ["item_id", "words"])

    return rows.mapInArrow(cut, "item_id string, words string").distinct()


def window_matches(postings: list[np.ndarray], order: np.ndarray, starts: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each match of one window.

    ``postings``: the list of each word in the order of the window; ``order``: its words from the rarest on; ``starts``: the
    first place of each document. With ``slop`` each word may stand that many places beside the one that the rarest asks for.
    """
    rarest = order[0]
    at = postings[rarest] - rarest
    first = last = postings[rarest]
    for k in order[1:]:
        if slop:
            doc = np.searchsorted(starts, at + rarest, "right")
            low = np.maximum(at + k - slop, starts[doc - 1])
            high = np.minimum(at + k + slop, np.r_[starts, np.iinfo(np.int32).max][doc] - 1)
        else:
            low = high = at + k
        places = postings[k]
        where = np.minimum(np.searchsorted(places, low), len(places) - 1)
        found = places[where]
        good = (found >= low) & (found <= high)
        at, first, last, found = at[good], first[good], last[good], found[good]
        if not len(at):
            break
        first, last = np.minimum(first, found), np.maximum(last, found)
    return first, last


class Segment:
    """The lists of one segment that its candidate windows ask for, and what was found in it."""

    def __init__(self, name: str):
        self.name, self.lists = name, {}
        self.n_words: list[int] = []
        self.firsts, self.lasts = [], []

    def find(self, words: list[str], slop: int) -> list[int]:
        """The slots of the documents in which a window stands."""
        lists = [self.lists.get(w) for w in words]
        if any(x is None for x in lists):
            return []
        first, last = window_matches(lists, np.argsort([len(x) for x in lists], kind="stable"), self.starts, slop)
        if not len(first):
            return []
        self.firsts.append(first)
        self.lasts.append(last)
        return np.unique(np.searchsorted(self.starts, first, "right") - 1).tolist()

    @cached_property
    def starts(self) -> np.ndarray:
        return np.cumsum(np.r_[0, np.array(self.n_words[:-1], np.int64) + 1])

    def spans(self) -> Iterator[tuple[int, list[dict]]]:
        """Per slot the merged spans of words that matches cover."""
        if not self.firsts:
            return
        edges = np.zeros(int(self.starts[-1]) + self.n_words[-1] + 2, np.int32)
        for first, last in zip(self.firsts, self.lasts, strict=True):
            np.add.at(edges, first, 1)
            np.add.at(edges, last + 1, -1)
        covered = np.diff(np.r_[0, (np.cumsum(edges) > 0).astype(np.int8)])
        begin, end = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
        slots = np.searchsorted(self.starts, begin, "right") - 1
        for slot in np.unique(slots).tolist():
            mine, base = slots == slot, int(self.starts[slot])
            yield slot, [{"start": b - base, "end": e - base} for b, e in zip(begin[mine].tolist(), end[mine].tolist(), strict=True)]


def segment_search(slop: int):
    """Rows come sorted by segment: first the words of its documents, then its lists, then its candidate windows."""
    schema = pa.schema([("segment", pa.string()), ("slot", pa.int32()), ("wid", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = None

        def finished() -> list[dict]:
            return [{"segment": segment.name, "slot": slot, "spans": spans} for slot, spans in segment.spans()] if segment else []

        for batch in batches:
            out = []
            for name, term, places, n_words, wid, words in zip(*(batch[c].to_pylist() for c in ("segment", "term", "places", "n_words", "wid", "words")), strict=True):
                if segment is None or name != segment.name:
                    out += finished()
                    segment = Segment(name)
                if n_words is not None:
                    segment.n_words = n_words
                elif places is not None:
                    segment.lists[term] = np.frombuffer(places, np.int32)
                else:
                    out += [{"segment": name, "slot": slot, "wid": wid} for slot in segment.find(words.split(" "), slop)]
            yield pa.RecordBatch.from_pylist(out, schema)
        yield pa.RecordBatch.from_pylist(finished(), schema)

    return look


def window_hits(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """(segment, slot, wid, spans): a row per document and window (wid, words) that stands in it, and one per such document with its spans."""
    small_batches(index.sparkSession)
    terms = stored(windows.select("wid", F.explode(F.array_distinct(F.split("words", " "))).alias("term")), "terms")
    lists = index.where("term IS NOT NULL")
    counts = lists.select("term", "n").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("total"))
    told = terms.join(counts, "term", "left").groupBy("wid").agg(F.min(F.struct("total", "term")).alias("rarest"), F.count_if(F.col("total").isNull()).alias("missing"))
    rarest = told.where("missing = 0").select("wid", F.col("rarest.term").alias("term"))
    candidates = stored(lists.select("segment", "term").join(rarest, "term").select("segment", "wid"), "candidates")
    asked = candidates.join(terms, "wid").select("segment", "term").distinct()
    meeting = ["segment", "kind", "term", "places", "n_words", "wid", "words"]
    blank = {"term": "string", "places": "binary", "n_words": "array<int>", "wid": "long", "words": "string"}
    shaped = lambda df, kind: df.select(*[F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in df.columns else F.lit(None).cast(blank[c]).alias(c) for c in meeting])
    about = index.where("n_words IS NOT NULL").select("segment", "n_words").join(candidates.select("segment").distinct(), "segment", "left_semi")
    # Lists of words in no candidate window drop out before any exchange where the words are few enough to be broadcast.
    wanted = lists.select("segment", "term", "places").join(terms.join(rarest.select("wid"), "wid", "left_semi").select("term").distinct(), "term", "left_semi")
    moved = wanted.join(asked, ["segment", "term"], "left_semi")
    rows = shaped(about, 0).union(shaped(moved, 1)).union(shaped(candidates.join(windows, "wid"), 2))
    return rows.repartition("segment").sortWithinPartitions("segment", "kind").mapInArrow(segment_search(slop), HITS)


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(segment, slot, items, spans): every document in which a window of an item occurs, its items and the spans of words that matches cover.

    ``slop`` 0 gives exact phrases; a larger one also gives proximity matches, whose words stand up to ``slop`` places beside
    their place in the window, in the same document.
    """
    cut = stored(item_windows(items, window), "windows")
    windows = stored(cut.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    hits = stored(window_hits(index, windows, slop), "hits")
    by_window = cut.join(windows, "words").select("wid", "item_id")
    found = hits.where("wid IS NOT NULL").join(by_window, "wid").select("segment", "slot", "item_id").distinct()
    items_of = found.groupBy("segment", "slot").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return items_of.join(hits.where("spans IS NOT NULL").select("segment", "slot", "spans"), ["segment", "slot"])


def words_covered(spans: Column) -> Column:
    """Number of words in the union of spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto")),
        lambda acc: acc["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, items (sorted ids) and spans (of words, end exclusive)."""
    index = build_index(docs, key)
    hits = search(index, items, window, slop)
    documents = index.where("n_words IS NOT NULL").select("segment", F.posexplode(F.arrays_zip("keys", "n_words")).alias("slot", "row"))
    rows = documents.select("segment", "slot", F.col("row.keys").alias(key), F.col("row.n_words").cast("long").alias("n_words"))
    found = rows.join(hits, ["segment", "slot"], "left")
    none = F.array().cast("array<string>")
    return found.select(key, "n_words", F.coalesce(words_covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), "spans")


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contamination(docs, items)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
