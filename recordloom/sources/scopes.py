"""Which record types a granted scope string lets a client read."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def scope_allows(scope: Column, resource_type: Column, allow_when_unknown: bool = True) -> Column:
    """Patient is always readable; a blank scope gives ``allow_when_unknown``."""
    tokens = F.split(F.trim(F.regexp_replace(F.coalesce(scope, F.lit("")), r"\s+", " ")), " ")
    granted = F.array(
        F.concat(F.lit("patient/"), resource_type, F.lit(".read")),
        F.concat(F.lit("user/"), resource_type, F.lit(".read")),
        F.lit("patient/*.read"),
        F.lit("user/*.read"),
        F.lit("*/*.read"),
    )
    blank = F.trim(F.regexp_replace(F.coalesce(scope, F.lit("")), r"\s+", " ")) == ""
    return F.when(resource_type == "Patient", True).when(blank, allow_when_unknown).otherwise(F.arrays_overlap(tokens, granted))
