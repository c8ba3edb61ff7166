"""Incremental state over file streams.

State is kept by Spark's own keyed aggregation: a batch reads and writes the state of its keys only. What a batch changed
goes to a log, a Parquet table partitioned by batch; a batch that is replayed after a lost executor or driver writes its own
partition again and nothing is applied twice. Readers take the newest row of each key.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import named_id
from ..operators.model_output import naming_key

_runs = itertools.count()


def next_run() -> int:
    """Number of a stream run inside this application, for folder names."""
    return next(_runs)


class ChangeLog:
    """Changed rows by batch in one Parquet table."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys

    def write(self, changes: DataFrame, batch_id: int) -> None:
        changes.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def changes(self, upto: int | None = None) -> DataFrame:
        """All changes with their ``batch``, up to and with a batch if one is given."""
        schema = f"{self.schema}, batch bigint"
        try:
            rows = self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException:  # no batch has been written yet
            return self.spark.createDataFrame([], schema)
        return rows if upto is None else rows.filter(F.col("batch") <= upto)

    def latest(self, upto: int | None = None) -> DataFrame:
        """The newest row of every key."""
        rows = self.changes(upto)
        columns = [c for c in rows.columns if c != "batch"]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), "batch").alias("_r")).select("_r.*")


def log_stream(changed: DataFrame, log: ChangeLog, checkpoint: str, mode: str = "update", after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Write what every micro-batch changed until the available files are consumed; ``after`` is told each finished batch."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        log.write(batch, batch_id)
        if after is not None:
            after(batch_id)

    return changed.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_rows(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key so far, as Spark keeps it between batches; of rows of equal order the one with the largest values stays."""
    rest = [c for c in stream.columns if c not in order]
    best = F.max_by(F.struct(*stream.columns), F.struct(*order, *rest))
    return stream.groupBy(*keys).agg(best.alias("_r")).select("_r.*")


def upsert_stream(stream: DataFrame, log: ChangeLog, order: list[str], checkpoint: str) -> StreamingQuery:
    return log_stream(newest_rows(stream, log.keys, order), log, checkpoint)


GROUP_KEY = ["patient_id", "group_key"]
NAMED_GROUP_SCHEMA = "patient_id string, group_key string, name string, bucket string, resource_types array<string>, confidence double, fallback boolean, n_records bigint"
NAMED_RECORD_SCHEMA = "patient_id string, record_id string"


def running_groups(names: DataFrame) -> DataFrame:
    """Running groups by (name, bucket): largest confidence, fallback if any, all record types; the name that landed first stays."""
    keyed = names.withColumn("group_key", naming_key(F.col("name"), F.col("bucket")))
    first = F.min_by(F.struct("name", "bucket"), F.struct("landed", "record_pos", "record_id"))
    grouped = keyed.groupBy(*GROUP_KEY).agg(
        first.alias("_f"), F.collect_set("resource_type").alias("resource_types"), F.max(F.col("confidence").cast("double")).alias("confidence"), F.bool_or("fallback").alias("fallback"), F.count(F.lit(1)).alias("n_records")
    )
    return grouped.select(*GROUP_KEY, "_f.name", "_f.bucket", F.array_sort("resource_types").alias("resource_types"), "confidence", "fallback", "n_records")


def group_view(state: DataFrame) -> DataFrame:
    gid = F.concat(named_id(F.col("name")), F.lit("-"), F.col("n_records").cast("string"))
    reason = F.when(F.col("fallback"), "source-label-fallback").otherwise("llm-naming")
    return state.select("patient_id", gid.alias("group_id"), "name", "bucket", "resource_types", "confidence", "fallback", "n_records", reason.alias("reason"))


class NamingRun:
    """Incremental grouping over a folder of named records, and what is still to be named after every batch."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, base: str, files_per_batch: int = 1):
        self.base = base
        files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        self.stream = files.select("*", F.col("_metadata.file_modification_time").alias("landed"))
        self.groups = ChangeLog(spark, f"{base}/groups", NAMED_GROUP_SCHEMA, GROUP_KEY)
        self.named = ChangeLog(spark, f"{base}/named", NAMED_RECORD_SCHEMA, ["patient_id", "record_id"])

    def run(self, after: Callable[[int], None] | None = None) -> None:
        """Consume what has landed. Both logs take the same files in the same batches; ``after`` sees a batch once both have it."""
        self.run_named()
        log_stream(running_groups(self.stream), self.groups, f"{self.base}/groups-progress", after=after).awaitTermination()

    def run_named(self) -> None:
        """Only log which records the files name, for those who ask for nothing else."""
        log_stream(self.stream.select("patient_id", "record_id"), self.named, f"{self.base}/named-progress", "append").awaitTermination()

    def view(self, batch_id: int | None = None) -> DataFrame:
        """The groups as they stood after a batch."""
        return group_view(self.groups.latest(batch_id))

    def pending(self, records: DataFrame, batch_id: int | None = None) -> DataFrame:
        """Records that no batch up to this one has named."""
        return pending_records(records, self.named.changes(batch_id))

    def pending_after(self, records: DataFrame, batches: int) -> DataFrame:
        """``pending`` for each of the first ``batches`` batches, told apart by ``batch``, from one join."""
        first = self.named.changes(batches - 1).groupBy("patient_id", F.col("record_id").alias("id")).agg(F.min("batch").alias("_named"))
        waits = F.slice(F.sequence(F.lit(0).cast("bigint"), F.lit(batches - 1).cast("bigint")), F.lit(1), F.coalesce(F.col("_named"), F.lit(batches)).cast("int"))
        return records.join(first, ["patient_id", "id"], "left").select(*records.columns, F.explode(waits).alias("batch"))


def pending_records(records: DataFrame, done: DataFrame) -> DataFrame:
    """Records no batch has named yet; shown one by one until they are."""
    return records.join(done.select("patient_id", F.col("record_id").alias("id")), ["patient_id", "id"], "left_anti")
