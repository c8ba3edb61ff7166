"""Session defaults and small physical helpers shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def build_session(app: str = "recordloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; cluster settings win where already given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_session(spark: SparkSession) -> SparkSession:
    """Timestamps are compared as UTC; a session that came with another zone is switched."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give work that is heavy per row at least one partition per core.

    A table in few large files is read by few tasks. With more splits than cores, as on large data, nothing changes. With ``keys`` the
    rows are always dealt by them, to as many partitions as the table or a shuffle has.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if keys:
        return df.repartition(max(cores, df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly value that is computed once per row.

    As the output of a generator it is neither substituted into later filters nor carried below a ``spread`` with them.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def saved(df: DataFrame) -> DataFrame:
    """A checkpoint for a result that several branches of a plan read: computed once, lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. Where none is set, a temporary one in a single-process session, else an error."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = os.path.join(tempfile.mkdtemp(prefix="spark-"), "checkpoints")
        context.setCheckpointDir(folder)
        current = context._jsc.sc().getCheckpointDir()
    return current.get()

