"""Byte pair encoding and decoding with a published vocabulary, by a pair occurrence index.

The distinct words of a batch lie in one array of symbols. An index holds, for each rank, all positions at which its pair
stands. The lowest active rank is taken first: all its positions merge at once, and only the pairs beside them are looked up
anew and listed under their ranks. Words are encoded once per batch, however often they occur.

Results for odd input: a null or empty text has no ids and decodes to an empty text; null ids decode to an empty text;
repeated rows get equal ids; other columns are neither read nor changed; an empty table gives an empty result. Texts of any
length are encoded whole; memory grows with the distinct words of a batch.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh, small_batches, vocabulary_path

#: White space of the vocabulary's patterns; str.split() also splits at U+001C to U+001F.
SPACES = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NO_RANK = np.int32(2**31 - 1)
END = "</w>"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """What encoding and decoding need of a word-end BPE file: symbols of bytes, merges by rank, token texts, special tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != END or spec["decoder"] is not None or split["type"] != "Split":
        raise ValueError(f"{path} is not a word-end BPE vocabulary")
    vocab, chars = model["vocab"], byte_characters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    names = {i: t for t, i in (vocab | special).items()}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return {
        "inner": np.array([vocab[c] for c in chars], np.int32),
        "last": np.array([vocab[c + END] for c in chars], np.int32),
        "left": np.array([vocab[a] for a, _ in merges], np.int64),
        "right": np.array([vocab[b] for _, b in merges], np.int64),
        "made": np.array([vocab[a + b] for a, b in merges], np.int32),
        "names": [names.get(i, "") for i in range(max(names) + 1)],
        "special": special,
        "words": split["pattern"]["Regex"].replace(r"[^\s", "[^" + SPACES),
    }


class PairIndex:
    """Merges words, given as bytes, into token ids."""

    def __init__(self, v: dict):
        self.v, self.size = v, np.int64(len(v["names"]))
        keys = v["left"] * self.size + v["right"]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        first = np.full(self.size, NO_RANK)  # the lowest rank of a pair that holds a symbol
        every = np.arange(len(keys), dtype=np.int32)
        np.minimum.at(first, v["left"], every)
        np.minimum.at(first, v["right"], every)
        self.one_by_one = first[v["made"]] < every  # a merge that can bring up a pair of lower rank

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in word order, and the number of ids of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if not lengths.sum():
            return np.empty(0, np.uint32), lengths
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths) - 1
        sym = self.v["inner"][raw].astype(np.int64)
        sym[ends] = self.v["last"][raw[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends], before[ends + 1 - lengths] = -1, -1
        alive = np.ones(n, bool)
        now = np.full(n, NO_RANK)  # the rank of the pair that starts at a position
        inner = np.flatnonzero(after >= 0)
        now[inner] = self.rank(sym[inner], sym[inner + 1])
        places: dict[int, list[np.ndarray]] = {}

        def listed(at: np.ndarray) -> None:
            at = at[now[at] < NO_RANK]
            if not len(at):
                return
            at = at[np.argsort(now[at], kind="stable")]
            ranks = now[at]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(active, rank)
                places[rank].append(part)

        active: list[int] = []
        listed(inner)
        while active:
            rank = heapq.heappop(active)
            parts = places.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[now[at] == rank]
            if not len(at):
                continue
            if self.v["left"][rank] == self.v["right"][rank] and len(at) > 1:  # of pairs that overlap, every second one from the left
                start = np.r_[True, after[at[:-1]] != at[1:]]
                run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            if self.one_by_one[rank]:
                first = np.r_[True, word[at[1:]] != word[at[:-1]]]
                if not first.all():
                    places[rank] = [at[~first]]
                    heapq.heappush(active, rank)
                    at = at[first]
            gone = after[at]
            rest = after[gone]
            sym[at] = self.v["made"][rank]
            after[at] = rest
            before[rest[rest >= 0]] = at[rest >= 0]
            alive[gone] = False
            now[gone] = NO_RANK
            beside = before[at]
            beside = beside[beside >= 0]
            touched = np.unique(np.concatenate([at, beside])) if len(beside) else at
            follows = after[touched]
            now[touched] = np.where(follows >= 0, self.rank(sym[touched], sym[follows]), NO_RANK)
            listed(touched)
        return sym[alive].astype(np.uint32), np.bincount(word[alive], minlength=len(words))


class Encoder:
    """Whole texts to ids, a batch at a time."""

    def __init__(self, v: dict):
        import regex

        self.index, self.special = PairIndex(v), v["special"]
        self.words = regex.compile(v["words"])
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.space = re.compile(f"[{SPACES}]+")

    def pieces(self, chunk: str) -> list[bytes | int]:
        """The words, as bytes, and special ids of a stretch without white space."""
        if self.cut and "<|" in chunk:
            found = []
            for part in self.cut.split(chunk):
                found += [self.special[part]] if part in self.special else self.pieces_of(part)
            return found
        return self.pieces_of(chunk)

    def pieces_of(self, part: str) -> list[bytes]:
        if part.isascii():
            part = part.lower()
            if part.isalpha():
                return [part.encode()]
        else:
            part = unicodedata.normalize("NFC", part)
            part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
        return [w.encode() for w in self.words.findall(part)]

    def chunks(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [c for c in self.space.split(text) if c]
        return text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        seen: set[str] = set()  # texts are split twice, so that only one text's chunks are held at a time
        for t in texts:
            seen.update(self.chunks(t or ""))
        found: dict[bytes, int] = {}
        pieces: dict[str, list[int]] = {}  # chunk to numbers of words; a special id k is -1 - k
        for chunk in seen:
            pieces[chunk] = [-1 - p if isinstance(p, int) else found.setdefault(p, len(found)) for p in self.pieces(chunk)]
        ids, counts = self.index.encode(list(found))
        packed, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
        starts, ends = ((ends - counts) * 4).tolist(), (ends * 4).tolist()
        done = {c: b"".join([packed[starts[p] : ends[p]] if p >= 0 else (-1 - p).to_bytes(4, "little") for p in ps]) for c, ps in pieces.items()}
        return [b"".join(map(done.__getitem__, self.chunks(t or ""))) for t in texts]


def decoded(ids: bytes | None, names: list[str]) -> str:
    """The text of packed ids."""
    return " ".join([names[i] for i in np.frombuffer(ids or b"", "<u4").tolist()])


def encoder(spark: SparkSession, vocabulary: str | None = None):
    """A column function: the ids of a text, packed as little-endian unsigned 32-bit integers. The vocabulary is broadcast; its size is fixed."""
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary or vocabulary_path("word_bpe_49k.json")))
    small_batches(spark, "4m")

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Encoder(shared.value)
        for batch in batches:
            yield pa.array(own.encode(batch.to_pylist()), pa.binary())

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, "binary")


def decoder(spark: SparkSession, vocabulary: str | None = None):
    """A column function: the text of packed ids; the vocabulary has no decoder, so tokens stand with spaces between them."""
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary or vocabulary_path("word_bpe_49k.json"))["names"])
    small_batches(spark, "4m")

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = shared.value
        for batch in batches:
            yield pa.array([decoded(ids, names) for ids in batch.to_pylist()], pa.string())

    decode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, "string")


def codec(spark: SparkSession, vocabulary: str | None = None):
    """A column function: packed ids of a text and the text that they decode to, both made in one Python worker a task instead of two."""
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary or vocabulary_path("word_bpe_49k.json")))
    small_batches(spark, "4m")

    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, names = Encoder(shared.value), shared.value["names"]
        for batch in batches:
            packed = own.encode(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array([decoded(ids, names) for ids in packed], pa.string())], ["ids", "decoded"])

    code.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(code, "ids binary, decoded string")


def encode(docs: DataFrame, text: str = "text", into: str = "ids", vocabulary: str | None = None) -> DataFrame:
    return docs.withColumn(into, encoder(docs.sparkSession, vocabulary)(F.col(text).cast("string")))


def decode(encoded: DataFrame, ids: str = "ids", into: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    return encoded.withColumn(into, decoder(encoded.sparkSession, vocabulary)(F.col(ids)))


def encode_decode(docs: DataFrame, text: str = "text", ids: str = "ids", into: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """The same as ``decode`` after ``encode``, in half the workers."""
    both = fresh(docs, "_coded")
    coded = docs.withColumn(both, codec(docs.sparkSession, vocabulary)(F.col(text).cast("string")))
    return coded.withColumns({ids: F.col(both)["ids"], into: F.col(both)["decoded"]}).drop(both)


def token_report(docs: DataFrame) -> DataFrame:
    """Number and digest of the ids, and digest of the decoded text, per document."""
    both = encode_decode(docs.select("doc_id", "text"))
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
