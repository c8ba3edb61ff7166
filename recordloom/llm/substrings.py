"""Suffix-array dedup: bytes that repeat a stretch of an earlier document are removed.

Only suffixes that can repeat are sorted. Every window of ``WINDOW`` bytes has a marker, the least hash of the ``GRAM``-byte
strings in it; equal windows have equal markers. Neighbouring windows with one marker form a run. Four jobs work on blocks of
documents, stored once and compressed:

1. Each block sends its distinct markers, by bucket; a marker seen in two documents is answered with a set bit.
2. Each block sends the distinct stretches of runs with such markers, by bucket, with the least document that has them.
3. In a bucket all windows of these stretches are sorted as suffixes, cut at ``WINDOW`` bytes, by deep-shallow sorting: a
   multikey quicksort over characters of eight bytes down to a shallow depth, then blind tries for groups that still share
   their prefix. Equal windows stand together; those of a later document than the first are answered with a set bit.
4. Each block marks the bytes of its answered windows and drops them.

Repeats within a block are settled in it, so a passage in a third of all documents is one stretch per block.

Results for odd input: null and empty texts have no bytes; a null doc_id counts as later than all others; rows with equal ids
do not remove each other's bytes; texts shorter than the window stay whole; other columns are not read; an empty table gives an
empty result. Texts are handled whole; a block holds one text at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, stored

WINDOW, GRAM = 50, 24
#: Windows of a run that go as one stretch: the bits of an answer.
STRETCH = 64
BLOCK_BYTES = "2m"
#: Bytes of text for each bucket of markers and stretches.
BUCKET_BYTES = 2 << 20
SHALLOW = 32
#: Bytes hashed in one vector.
SLICE = 1 << 19
LAST = np.iinfo(np.int64).max

BLOCK = "block string, doc_ids array<long>, sizes array<int>, texts binary"
ANSWER = "block string, kind int, bucket int, bits binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(3).compress(b"".join(a.tobytes() for a in arrays))


def unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def markers(text: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The least mixed hash of a gram in the window that starts at each byte."""

    def sliding(values: np.ndarray, width: int, join) -> np.ndarray:
        """``join`` over ``width`` neighbours; doubles the span and joins what is left over with an overlap or a remainder."""
        parts, span = {1: values}, 1
        while span * 2 <= width:
            parts[span * 2] = join(parts[span][:-span], parts[span][span:], span)
            span *= 2
        out, done = parts[span], span
        while done < width:
            span = max(s for s in parts if s <= width - done)
            out = join(out[: len(parts[span]) - done], parts[span][done:], span)
            done += span
        return out

    def hashed(left: np.ndarray, right: np.ndarray, span: int) -> np.ndarray:
        return left * np.uint64(pow(0x100000001B3, span, 1 << 64)) + right

    found = []
    for low in range(0, len(text) - window + 1, SLICE):
        part = text[low : low + SLICE + window - 1].astype(np.uint64) + np.uint64(1)
        grams = mixed(sliding(part, gram, hashed))
        found.append(sliding(grams, window - gram + 1, lambda a, b, _: np.minimum(a, b)))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


class Block:
    """The runs of a block of documents and their markers by bucket."""

    def __init__(self, row: dict, buckets: int):
        self.ids = np.array([LAST if i is None else i for i in row["doc_ids"]], np.int64)
        self.doc_ids = row["doc_ids"]
        self.text = np.frombuffer(unpacked(row["texts"]), np.uint8)
        self.sizes = np.array(row["sizes"], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        edges = np.zeros(len(self.text) + 1, np.int64)
        long = self.sizes >= WINDOW
        np.add.at(edges, self.offsets[long], 1)
        np.add.at(edges, (self.offsets + self.sizes)[long] - WINDOW + 1, -1)
        at = np.flatnonzero(np.cumsum(edges) > 0)
        mark = markers(self.text)[at]
        new = np.flatnonzero(np.r_[True, (mark[1:] != mark[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.empty(0, np.int64)
        length = np.diff(np.r_[new, len(at)])
        pieces = -(-length // STRETCH)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.start = np.repeat(at[new], pieces) + nth * STRETCH
        self.count = np.minimum(np.repeat(length, pieces) - nth * STRETCH, STRETCH)
        self.mark = np.repeat(mark[new], pieces)
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        # Empty texts share their offset with the next one; the last of equal offsets is the one with bytes.
        self.bucket = (mixed(self.mark) >> np.uint64(32)).astype(np.int64) % buckets
        order = np.lexsort((self.ids[self.doc], self.mark, self.bucket))
        sorted_mark, sorted_id = self.mark[order], self.ids[self.doc][order]
        first = np.flatnonzero(np.r_[True, sorted_mark[1:] != sorted_mark[:-1]]) if len(order) else np.empty(0, np.int64)
        last = np.r_[first[1:], len(order)] - 1 if len(order) else first
        self.marks = sorted_mark[first]
        self.repeated = sorted_id[first] != sorted_id[last]
        self.marks_bucket = self.bucket[order][first]

    def by_bucket(self, buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
        cuts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(buckets) else []
        for low, high in zip(cuts, [*cuts[1:], len(buckets)], strict=True):
            yield int(buckets[low]), slice(low, high)

    def stretches(self, answers: dict[int, bytes]) -> None:
        """Keep the distinct stretches whose marker was answered; each with its least document and where it stands."""
        good = np.zeros(len(self.marks), bool)
        for bucket, part in self.by_bucket(self.marks_bucket):
            if bucket in answers:
                good[part] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=part.stop - part.start).astype(bool)
        wanted = np.sort(self.marks[good])
        at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, self.mark), len(wanted) - 1)] == self.mark) if len(wanted) else np.empty(0, np.int64)
        at = at[np.argsort(self.bucket[at], kind="stable")]
        whole = self.text.tobytes()
        numbers: dict[bytes, int] = {}
        starts, ends = self.start[at].tolist(), (self.start[at] + self.count[at] + WINDOW - 1).tolist()
        self.which = np.array([numbers.setdefault(whole[a:b], len(numbers)) for a, b in zip(starts, ends, strict=True)], np.int64)
        self.at, self.texts = at, list(numbers)
        self.least = np.full(len(numbers), LAST)
        np.minimum.at(self.least, self.which, self.ids[self.doc[at]])
        first = np.unique(self.which, return_index=True)[1]
        self.text_bucket, self.text_count = self.bucket[at][first], self.count[at][first]


def sorted_windows(text: np.ndarray, starts: np.ndarray, window: int = WINDOW, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows that start at ``starts``, and whether each equals its predecessor in that order."""
    word = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for span in (1, 2, 4):  # the eight bytes from each place on, as one number
        word = (word[:-span] << np.uint64(8 * span)) | word[span:]
    depths = [*range(0, window - 7, 8)] + ([window - 8] if window % 8 else [])
    order = np.argsort(word[starts], kind="stable")
    new = np.r_[True, word[starts[order[1:]]] != word[starts[order[:-1]]]]
    for depth in depths[1:]:
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        active = np.flatnonzero(size[group] > 1)
        if not len(active):
            return order, ~new
        if depth >= shallow:
            break
        key = word[starts[order[active]] + depth]
        inside = np.lexsort((key, group[active]))
        order[active] = order[active[inside]]
        key = key[inside]
        new[active[1:]] |= (np.diff(key) != 0) & (np.diff(active) == 1)
    else:
        return order, ~new
    # Groups that still share their prefix: those of equal windows are a single leaf, the others go through a blind trie.
    first = np.flatnonzero(new)
    leader = starts[order[first[group[active]]]]
    odd = np.zeros(len(active), bool)
    for deep in [d for d in depths if d >= shallow or d + 8 > shallow]:
        odd |= word[starts[order[active]] + deep] != word[leader + deep]
    data = text.tobytes()
    for g in np.unique(group[active][odd]).tolist():
        low, high = int(first[g]), int(first[g] + size[g])
        trie = BlindTrie(data, window)
        for n in order[low:high].tolist():
            trie.add(int(starts[n]), n)
        at = low
        for leaf in trie.leaves():
            order[at : at + len(leaf)] = leaf
            new[at] = True
            at += len(leaf)
    return order, ~new


class BlindTrie:
    """A trie that stores only where its strings branch; a string is compared once, with the leaf that a blind descent reaches."""

    def __init__(self, data: bytes, window: int):
        self.data, self.window, self.root = data, window, None

    def add(self, start: int, name: int) -> None:
        if self.root is None:
            self.root = (start, [name])
            return
        node = self.root
        while len(node) == 3:  # (depth, children, any start below)
            node = node[1].get(self.data[start + node[0]]) or next(iter(node[1].values()))
        mine, other = self.data[start : start + self.window], self.data[node[0] : node[0] + self.window]
        if mine == other:
            node[1].append(name)
            return
        depth = next(i for i, (a, b) in enumerate(zip(mine, other, strict=True)) if a != b)
        above, node = None, self.root
        while len(node) == 3 and node[0] < depth:
            above, node = node, node[1][mine[node[0]]]
        if len(node) == 3 and node[0] == depth:
            node[1][mine[depth]] = (start, [name])
            return
        branch = (depth, {other[depth]: node, mine[depth]: (start, [name])}, start)
        if above is None:
            self.root = branch
        else:
            above[1][mine[above[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if len(node) == 2:
                yield node[1]
            else:
                stack += [node[1][byte] for byte in sorted(node[1], reverse=True)]


def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for n, batch in enumerate(batches):
        if batch.num_rows:
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            cells = [[f"{part}-{n}"], [batch["doc_id"].to_pylist()], [list(map(len, texts))], [packed(np.frombuffer(b"".join(texts), np.uint8))]]
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["block", "doc_ids", "sizes", "texts"])


def answer_table(rows: list[tuple[str, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table({"block": pa.array(columns[0], pa.string()), "kind": pa.array(columns[1], pa.int32()), "bucket": pa.array(columns[2], pa.int32()), "bits": pa.array(columns[3], pa.binary())})


def send_markers(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, buckets)
                codes = (mixed(block.marks) & np.uint64(0xFFFFFFFF)).astype("<u4")
                parts = [(b, codes[s].tobytes(), np.packbits(block.repeated[s]).tobytes()) for b, s in block.by_bucket(block.marks_bucket)]
                if parts:
                    cells = list(zip(*parts, strict=True))
                    kinds = [pa.int32(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(parts)), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))], ["block", "bucket", "codes", "repeated"])

    return send


def answer_markers(rows: pa.Table) -> pa.Table:
    """Per block a bit for each of its markers: another block or a second document has it."""
    codes = [np.frombuffer(c, "<u4") for c in rows["codes"].to_pylist()]
    every = np.sort(np.concatenate(codes))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for block, bucket, own, repeated in zip(rows["block"].to_pylist(), rows["bucket"].to_pylist(), codes, rows["repeated"].to_pylist(), strict=True):
        bits = np.unpackbits(np.frombuffer(repeated, np.uint8), count=len(own)).astype(bool)
        if len(shared):
            bits |= shared[np.minimum(np.searchsorted(shared, own), len(shared) - 1)] == own
        if bits.any():
            out.append((block, 0, bucket, np.packbits(bits).tobytes()))
    return answer_table(out)


def send_stretches(buckets: int):
    def send(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for row in blocks.to_pylist():
            block = Block(row, buckets)
            block.stretches(dict(zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True)))
            for bucket, s in block.by_bucket(block.text_bucket):
                joined = np.frombuffer(b"".join(block.texts[s]), np.uint8)
                rows.append((row["block"], bucket, s.stop - s.start, packed(block.text_count[s].astype(np.uint8), block.least[s], joined)))
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.table({"block": pa.array(columns[0], pa.string()), "bucket": pa.array(columns[1], pa.int32()), "n": pa.array(columns[2], pa.int32()), "data": pa.array(columns[3], pa.binary())})

    return send


def answer_stretches(rows: pa.Table) -> pa.Table:
    """Per block and stretch the windows that a document before the stretch's least one has, as bits."""
    numbers, counts, least, texts = rows["n"].to_pylist(), [], [], []
    for n, data in zip(numbers, rows["data"].to_pylist(), strict=True):
        raw = unpacked(data)
        counts.append(np.frombuffer(raw, np.uint8, n))
        least.append(np.frombuffer(raw, "<i8", n, n))
        texts.append(np.frombuffer(raw, np.uint8, offset=9 * n))
    count, doc, text = np.concatenate(counts).astype(np.int64), np.concatenate(least), np.concatenate(texts)
    size = count + WINDOW - 1
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    order, same = sorted_windows(text, begin[owner] + nth)
    group = np.cumsum(~same) - 1
    docs = doc[owner[order]]
    first = np.minimum.reduceat(docs, np.flatnonzero(~same))[group]
    late = np.zeros(len(owner), bool)
    late[order] = docs > first
    bits = np.zeros(len(count), np.uint64)
    np.bitwise_or.at(bits, owner[late], np.uint64(1) << nth[late].astype(np.uint64))
    upto = np.cumsum(numbers)
    return answer_table([(block, 1, bucket, packed(bits[end - n : end])) for block, bucket, n, end in zip(rows["block"].to_pylist(), rows["bucket"].to_pylist(), numbers, upto.tolist(), strict=True) if bits[end - n : end].any()])


def drop_bytes(buckets: int):
    def drop(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        of_kind: list[dict[int, bytes]] = [{}, {}]
        for kind, bucket, bits in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
            of_kind[kind][bucket] = bits
        out: list[tuple] = []
        for row in blocks.to_pylist():
            block = Block(row, buckets)
            block.stretches(of_kind[0])
            bits = np.zeros(len(block.texts), np.uint64)
            for bucket, s in block.by_bucket(block.text_bucket):
                if bucket in of_kind[1]:
                    bits[s] = np.frombuffer(unpacked(of_kind[1][bucket]), "<u8")
            start, count = block.start[block.at], block.count[block.at]
            edges = np.zeros(len(block.text) + 1, np.int64)
            later = block.ids[block.doc[block.at]] > block.least[block.which]
            np.add.at(edges, start[later], 1)
            np.add.at(edges, (start + count)[later] + WINDOW - 1, -1)
            first = ~later & (bits[block.which] > 0)
            mask = np.unpackbits(bits[block.which[first]][:, None].view(np.uint8), axis=1, bitorder="little").astype(bool)
            which, nth = np.nonzero(mask)
            windows = start[first][which] + nth
            np.add.at(edges, windows, 1)
            np.add.at(edges, windows + WINDOW, -1)
            gone = np.cumsum(edges[:-1]) > 0
            for doc_id, low, size in zip(block.doc_ids, block.offsets.tolist(), row["sizes"], strict=True):
                own = gone[low : low + size]
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
                out.append((doc_id, size, int(own.sum()), spans, block.text[low : low + size][~own].tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
        return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), columns, strict=True)})

    return drop


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row; ``kept`` holds the bytes that are left."""
    small_batches(docs.sparkSession, BLOCK_BYTES)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = stored(texts.mapInArrow(make_blocks, BLOCK), "blocks")
    total = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n")).first().n or 0
    buckets = int(max(16, -(-total // BUCKET_BYTES)))
    sent = blocks.mapInArrow(send_markers(buckets), "block string, bucket int, codes binary, repeated binary")
    known = stored(sent.groupBy("bucket").applyInArrow(answer_markers, ANSWER), "marker-answers")
    stretches = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(send_stretches(buckets), "block string, bucket int, n int, data binary")
    found = stored(stretches.groupBy("bucket").applyInArrow(answer_stretches, ANSWER), "stretch-answers")
    return blocks.groupBy("block").cogroup(known.unionByName(found).groupBy("block")).applyInArrow(drop_bytes(buckets), RESULT)


def repeats_report(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
