"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir, read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: computed once, lineage cut, any executor can read it."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The ``rows`` rows with the lowest hashes of ``keys``, or all if there are fewer.

    Hashes above twice the share that is wanted are dropped where they are read, so the task that sorts gets about twice
    ``rows`` however many there are.
    """
    share = min(1.0, 2 * rows / max(1, df.count()))
    hashed = F.xxhash64(*keys)
    low = df.where(hashed < F.lit(int(-(2**63) + share * (2**64 - 1024)))) if share < 1 else df
    return low.orderBy(hashed, *keys).limit(rows)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, size: str = "16m") -> None:
    """Python tasks get Arrow batches of at most this many bytes, whatever the length of the texts (a row is never cut)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer's file on the driver; executors get its content by broadcast."""
    import public_tokenizers

    return public_tokenizers.path(name)
