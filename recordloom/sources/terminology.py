"""Terminology files in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.coding import canonical_system, parse_coding_key

TERM_FIELDS = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("name", "friendly_source", "match_type", "cui", "tty", "canonical_code", "canonical_system")
    ]
)
SHARD_SCHEMA = T.MapType(T.StringType(), TERM_FIELDS)


def shard_entries(shards: DataFrame, system: Column, payload: str = "value") -> DataFrame:
    """Rows of ``{code: {name, ...}}`` objects; entries without a name string are skipped."""
    keep = [c for c in shards.columns if c not in (payload, "system")]
    exploded = shards.select(*keep, system.alias("system"), F.explode(F.from_json(payload, SHARD_SCHEMA)).alias("code", "_e"))
    return exploded.filter(F.col("_e.name").isNotNull()).select(
        *keep,
        "system",
        "code",
        F.col("_e.name").alias("name"),
        F.coalesce("_e.friendly_source", F.lit("")).alias("friendly_source"),
        F.coalesce("_e.match_type", F.lit("")).alias("match_type"),
        F.col("_e.cui").alias("cui"),
        F.col("_e.tty").alias("tty"),
        canonical_system(F.col("_e.canonical_system")).alias("canonical_system"),
        F.col("_e.canonical_code").alias("canonical_code"),
    )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """A folder written as ``system=<name>/*.json``; Spark prunes to the systems a query filters on."""
    return shard_entries(spark.read.option("wholetext", True).text(path), F.col("system"))


def read_shard_lines(spark: SparkSession, path: str, schema: str = "code string, name string") -> DataFrame:
    """A folder as ``write_shards`` leaves it, one entry per line: large shards are read by many tasks, and only those of the systems asked for."""
    return spark.read.schema(f"{schema}, system string").json(path)


def systems_in_records(coding_keys: DataFrame, key: str = "coding_key") -> DataFrame:
    """Distinct terminology systems that occur in a column of coding keys (one key per row)."""
    return coding_keys.select(parse_coding_key(F.col(key))["system"].alias("system")).filter("system is not null").distinct()


def restrict_to_systems(terms: DataFrame, coding_keys: DataFrame, key: str = "coding_key") -> DataFrame:
    return terms.join(systems_in_records(coding_keys, key), "system", "left_semi")


def read_checked_csv(spark: SparkSession, path: str, header: list[str], schema: str) -> DataFrame:
    """Quoted CSV whose header must start with ``header``; fails before any data is read otherwise."""
    found = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path).columns
    if found[: len(header)] != header:
        raise ValueError(f"unexpected header {found[: len(header)]}, expected {header}")
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').schema(schema).csv(path)


def csv_line_fields(line: Column, schema: str) -> Column:
    """The same quoting rules for single lines that arrive in a column."""
    return F.from_csv(line, F.lit(schema), {"quote": '"', "escape": '"'})


def shard_manifest(rows: DataFrame, system: str = "system") -> DataFrame:
    return rows.groupBy(system).agg(F.count(F.lit(1)).alias("entries"))


def write_shards(rows: DataFrame, path: str, system: str = "system") -> None:
    """One folder per system plus a manifest of counts; rows spread over all tasks, no single writer."""
    rows.write.mode("overwrite").partitionBy(system).json(f"{path}/shards")
    shard_manifest(rows, system).write.mode("overwrite").json(f"{path}/manifest")
