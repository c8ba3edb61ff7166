"""Secret scans: published patterns, and a token-efficiency test for strings that no pattern knows.

A vocabulary trained on text spends about one token on four characters of words, and one on two or fewer of a random
string. A run of key characters is exposed when its characters per token stay below a limit, after digests of known length,
UUIDs and account numbers are set aside. The ratio decides for every kind of run: where letters of one case, capitals or digits stand
alone or as pieces joined by separators, which is how words and names look, the limit is lower; runs of digits alone are numbers.
Of a run with separators that passes as a whole, pieces that are long enough are tested by themselves.

Results for odd input: a null or empty text has no span; ties cannot occur, as spans are ordered by start and then by kind;
repeated rows are scanned alike; other columns are neither read nor changed; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import vocabulary_path

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
#: Characters per token at which a run is exposed: of mixed characters, and of letters of one case in pieces. Invented words of
#: 16 letters and more in the given tables have 1.8 to 4.2 but for two in 10,000 documents; random letters mostly stay below 1.7.
MIN_LENGTH, MAX_RATIO, MAX_WORD_RATIO = 16, 2.2, 1.7

ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
ACCOUNT = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}\Z")
WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|\d+)(?:[-_/+](?:[A-Z]?[a-z]+|[A-Z]+|\d+))*\Z")

NUMBER = re.compile(r"[\d+/_-]+\Z")
PIECE = re.compile(r"[A-Za-z0-9]+")

SPANS = "array<struct<kind:string,start:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the published patterns; per kind leftmost and non-overlapping."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def known_identifier(run: str) -> bool:
    return bool(len(run) in DIGEST_LENGTHS and DIGEST.match(run) or UUID.match(run) or ACCOUNT.match(run) or NUMBER.match(run))


def exposed(run: str, count_tokens: Callable[[str], int], max_ratio: float = MAX_RATIO, max_word_ratio: float = MAX_WORD_RATIO) -> bool:
    """Whether the vocabulary needs so many tokens for a run that it is no word."""
    return not known_identifier(run) and len(run) < (max_word_ratio if WORDS.match(run) else max_ratio) * count_tokens(run)


def random_spans(text: str, count_tokens: Callable[[str], int], min_length: int = MIN_LENGTH, max_ratio: float = MAX_RATIO) -> Iterator[tuple[int, int, int]]:
    """(start, place of the kind, end) of exposed runs, or of the exposed pieces of a run."""
    for m in RUN.finditer(text):
        if len(m[0]) >= min_length and exposed(m[0], count_tokens, max_ratio):
            yield m.start(), 3, m.end()
        elif not known_identifier(m[0]):
            for piece in PIECE.finditer(m[0]):
                if min_length <= len(piece[0]) < len(m[0]) and exposed(piece[0], count_tokens, max_ratio):
                    yield m.start() + piece.start(), 3, m.start() + piece.end()


def secret_spans(spark: SparkSession, vocabulary: str | None = None, min_length: int = MIN_LENGTH, max_ratio: float = MAX_RATIO):
    """A column function: all spans of a text, by start and then by kind, in code points, end exclusive.

    The ranks of the vocabulary are broadcast; their number is fixed by the file.
    """
    from public_tokenizers import PATTERN

    with open(vocabulary or vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = spark.sparkContext.broadcast({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})

        def count_tokens(run: str) -> int:
            return len(encoding.encode_ordinary(run))

        for batch in batches:
            offsets, kinds, starts, ends = [0], [], [], []
            for text in batch:
                whole = text.as_py() or ""
                for start, kind, end in sorted([*base_spans(whole), *random_spans(whole, count_tokens, min_length, max_ratio)]):
                    kinds.append(KINDS[kind])
                    starts.append(start)
                    ends.append(end)
                offsets.append(len(kinds))
            spans = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["kind", "start", "end"])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)

    scan.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scan, SPANS)


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secret_spans", **options) -> DataFrame:
    """``docs`` with the spans of each whole text in the column ``into``."""
    return docs.withColumn(into, secret_spans(docs.sparkSession, **options)(F.col(text).cast("string")))


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, overlaps joined, replaced by ``mask``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("upto"))
    kept = F.aggregate(
        spans,
        start,
        lambda acc, s: F.when(s["start"] >= acc["upto"], F.struct(F.concat(acc["out"], F.substring(text, acc["upto"] + 1, s["start"] - acc["upto"]), F.lit(mask)).alias("out"), s["end"].alias("upto"))).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["upto"], s["end"]).alias("upto"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["upto"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, kept).otherwise(text)


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets_report(docs: DataFrame) -> DataFrame:
    """Counts per published kind, a digest of the published spans and the list of all spans, per document."""
    found = find_secrets(docs.select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["kind"] != "random")

    def count(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))
