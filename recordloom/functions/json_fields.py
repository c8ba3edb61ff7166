"""Typed access to one open JSON object held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .coding import CONCEPT_TYPE


def field(body: Column, path: str, dtype: str) -> Column:
    return F.try_variant_get(body, f"$.{path}", dtype)


def kind_of(body: Column, path: str) -> Column:
    """Type name of a field as written, e.g. STRING, BIGINT, DECIMAL(3,1), ARRAY<...>."""
    return F.schema_of_variant(field(body, path, "variant"))


def text(body: Column, path: str) -> Column:
    """The field as text. A number or flag where a text is expected is read as its text."""
    return field(body, path, "string")


def parse_once(df: DataFrame, source: str | Column, alias: str = "body") -> DataFrame:
    """Replace JSON text by a VARIANT that is parsed exactly once per row.

    Later filters and projections refer to the parsed column many times; as the output of a generator it is not
    substituted back into them. A text that is no JSON gives null.
    """
    text_col = F.col(source) if isinstance(source, str) else source
    keep = [c for c in df.columns if c != source and c != alias]
    return df.select(*keep, F.explode(F.array(F.try_parse_json(text_col))).alias(alias))


def number(body: Column, path: str) -> Column:
    return F.when(kind_of(body, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), field(body, path, "double"))


def boolean(body: Column, path: str) -> Column:
    return F.when(kind_of(body, path) == "BOOLEAN", field(body, path, "boolean"))


def concept(body: Column, path: str) -> Column:
    return field(body, path, CONCEPT_TYPE)


def concepts(body: Column, path: str) -> Column:
    """A list of concepts, also when the field holds a single one; empty when absent."""
    single = concept(body, path)
    return F.coalesce(
        field(body, path, f"array<{CONCEPT_TYPE}>"),
        F.when(single.isNotNull(), F.array(single)),
        F.array().cast(f"array<{CONCEPT_TYPE}>"),
    )


def references(body: Column, path: str, only_list: bool = False) -> Column:
    """Reference strings of a field that holds one reference or a list of them."""
    shape = "struct<reference:string>"
    listed = field(body, path, f"array<{shape}>")
    single = F.lit(None).cast(f"array<{shape}>") if only_list else F.when(field(body, path, shape).isNotNull(), F.array(field(body, path, shape)))
    found = F.coalesce(listed, single, F.array().cast(f"array<{shape}>"))
    return F.filter(F.transform(found, lambda r: r["reference"]), lambda r: F.nullif(r, F.lit("")).isNotNull())


def period_start(body: Column, path: str) -> Column:
    return F.coalesce(F.nullif(field(body, f"{path}.start", "string"), F.lit("")), F.nullif(field(body, f"{path}.end", "string"), F.lit("")))
