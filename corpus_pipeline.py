"""From raw documents to training tokens: five stages, each a DataFrame job over all rows that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared folder and
hands it, read again, to the next. All but the last return the columns of their input.

Odd input: rows with a null text count as empty; a null or repeated doc_id never merges or drops rows by itself; of equal
rows one stays after the near-duplicate stage; tables without rows or labels pass through; further columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm import bpe, decontamination, quality, secrets, simhash
from recordloom.llm.common import fresh, stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of being good is one half or more."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    row = fresh(docs, "_row")
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    named = keyed.select("text", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(row).alias("row")).alias("key"))
    first = simhash.near_duplicates(named, key="key").where("key = component_id").select(F.col("key.row").alias(row))
    return keyed.join(first, row, "left_semi").select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    found = decontamination.contamination(docs.select("text", digest.alias("digest")), table(spark, sf_dir, "benchmark"), key="digest")
    own = fresh(docs, "_digest")
    leaked = found.where("n_hit > 0").select(F.col("digest").alias(own)).distinct()
    return docs.withColumn(own, digest).join(leaked, own, "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret masked; n_chars follows the text."""
    spans, changed = fresh(docs, "_spans"), fresh(docs, "_masked")
    found = secrets.find_secrets(docs, into=spans)
    text = F.when(F.size(spans) > 0, secrets.masked(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    n_chars = F.when(F.size(spans) > 0, F.length(changed).cast("long")).otherwise(F.col("n_chars"))
    own = {"text": F.col(changed), "n_chars": n_chars}
    return found.withColumn(changed, text).select(*[own.get(c, F.col(c)).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed as little-endian unsigned 32-bit integers, and the text that they decode to."""
    coded = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", distinct_documents),
    ("decontamination", uncontaminated),
    ("secrets", without_secrets),
    ("bpe", tokens),
]

#: SQL has no string model for the fit, the fingerprints, the vocabulary test and the merges; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
