"""Record bundles to rows, and several connected sources to one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.json_fields import field, parse_once, text
from ..functions.text import fnv1a_base36

RESOURCE_COLUMNS = ["source_id", "patient_id", "input_pos", "resource_type", "id", "body"]


def bundle_entries(bundles: DataFrame, body: str = "body") -> DataFrame:
    """One row per ``entry[].resource``; anything that is not a Bundle yields nothing.

    ``bundles`` has a VARIANT column ``body``; its other columns are carried along. ``entry_pos`` is
    the position inside the bundle.
    """
    keep = [c for c in bundles.columns if c != body]
    entries = field(F.col(body), "entry", "array<variant>")
    listed = bundles.filter(text(F.col(body), "resourceType") == "Bundle").select(*keep, F.posexplode(entries).alias("entry_pos", "_entry"))
    resource = F.try_variant_get(F.col("_entry"), "$.resource", "variant")
    rows = listed.select(*keep, "entry_pos", resource.alias("body")).filter(F.schema_of_variant("body").startswith("OBJECT"))
    return rows.select(
        *keep,
        "entry_pos",
        text(F.col("body"), "resourceType").alias("resource_type"),
        text(F.col("body"), "id").alias("id"),
        "body",
    )


#: A position is the number of the file, in order of names, and below it the position inside the file.
FILE_BITS = 40


def numbered_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, file_no)`` of the files of a folder in order of their names; contents are not read, so the one sort sees a name per file."""
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
    return names.withColumn("file_no", F.row_number().over(Window.orderBy("path")).cast("bigint") - 1)


def with_positions(rows: DataFrame, files: DataFrame, inside: str) -> DataFrame:
    """``rows(path, inside)`` with ``input_pos``, so that pages of one patient follow each other and never share a position."""
    return rows.join(files, "path").withColumn("input_pos", F.shiftleft("file_no", FILE_BITS) + F.col(inside)).drop("file_no", inside)


def read_bundles(spark: SparkSession, path: str, source_id: Column, patient_id: Column) -> DataFrame:
    """Scan a folder of bundle files (one JSON document per file) into the resource model.

    ``source_id`` and ``patient_id`` are expressions over ``path`` (the file) and ``body``. A bundle file is read by one task,
    files are read in parallel; several files of one source and patient are its pages, in order of their names.
    """
    files = parse_once(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"), "value")
    keyed = files.select("path", source_id.alias("source_id"), patient_id.alias("patient_id"), "body")
    rows = bundle_entries(keyed).withColumn("_at", F.col("entry_pos").cast("bigint"))
    return with_positions(rows, numbered_files(spark, path), "_at").select(*RESOURCE_COLUMNS)


def read_resource_lines(spark: SparkSession, path: str, source_id: Column, patient_id: Column) -> DataFrame:
    """Scan a folder of files with one resource per line into the resource model; a large file is read by many tasks.

    Lines are numbered inside the split that reads them, from the split's first byte on. A split has no more lines than bytes,
    so the numbers of a file ascend. Lines that hold no resource are left out.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") + row).alias("_at"), "value")
    parsed = parse_once(lines, "value").filter(F.schema_of_variant("body").startswith("OBJECT") & text(F.col("body"), "resourceType").isNotNull())
    keyed = parsed.select("path", "_at", source_id.alias("source_id"), patient_id.alias("patient_id"), text(F.col("body"), "resourceType").alias("resource_type"), text(F.col("body"), "id").alias("id"), "body")
    return with_positions(keyed, numbered_files(spark, path), "_at").select(*RESOURCE_COLUMNS)


def source_id_for(base_url: Column, patient_id: Column) -> Column:
    patient = F.coalesce(F.nullif(patient_id, F.lit("")), F.lit("unknown-patient"))
    return F.concat(F.lit("src-"), fnv1a_base36(F.concat(F.regexp_replace(base_url, "/$", ""), F.lit("|"), patient)))


def scope_to_source(df: DataFrame, source_id: Column, source_name: Column, id_col: str = "id") -> DataFrame:
    """Prefix record ids with their source and stamp the portal, so sources can be concatenated."""
    return df.withColumns(
        {
            id_col: F.concat(source_id, F.lit(":"), F.col(id_col)),
            "portal_source_id": source_id,
            "portal_source_name": source_name,
        }
    )


def merge_sources(*summaries: DataFrame) -> DataFrame:
    out = summaries[0]
    for nxt in summaries[1:]:
        out = out.unionByName(nxt, allowMissingColumns=True)
    return out


def source_label(provider_name: Column, patient_name: Column, display_name: Column, base_url: Column) -> Column:
    provider, patient = F.nullif(provider_name, F.lit("")), F.nullif(patient_name, F.lit(""))
    host = F.regexp_replace(F.coalesce(F.try_parse_url(base_url, F.lit("HOST")), base_url), r"^www\.", "")
    both = F.when(provider.isNotNull() & patient.isNotNull(), F.concat(provider, F.lit(" · "), patient))
    return F.coalesce(both, provider, patient, F.nullif(display_name, F.lit("")), host)


def source_status(sources: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Roll-up over ``sources(status, resource_count, record_count, unresolved, skipped)``."""
    return sources.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.sum(F.coalesce("resource_count", "record_count", F.lit(0))).cast("bigint").alias("n_resources"),
        F.count_if(F.col("status").isin("error", "needs-reconnect")).alias("n_reconnect"),
        F.sum(F.coalesce("unresolved", F.lit(0)) + F.coalesce("skipped", F.lit(0))).cast("bigint").alias("n_unresolved"),
    )
