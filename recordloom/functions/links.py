"""Parsing of references between resources."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import blank_to_null

# Record types that can be grouped and linked.
GROUPABLE_TYPES = (
    "MedicationRequest", "AllergyIntolerance", "Condition", "Observation",
    "Immunization", "Encounter", "Procedure", "DiagnosticReport",
)


def local_reference(reference: Column) -> Column:
    """STRUCT<resource_type, id> of the last 'Type/id' of a reference, groupable types only.

    Query and history parts are dropped, the id is URL-decoded; an undecodable id gives null.
    """
    bare = F.regexp_replace(F.substring_index(reference, "?", 1), r"/_history/[^/]+$", "")
    pattern = r"(?:^|/)([A-Za-z]+)/([^/]+)$"
    rtype = F.regexp_extract(bare, pattern, 1)
    rid = F.trim(F.try_url_decode(F.replace(F.regexp_extract(bare, pattern, 2), F.lit("+"), F.lit("%2B"))))
    usable = (F.trim(reference) != "") & ~reference.startswith("#") & rtype.isin(*GROUPABLE_TYPES) & (rid != "")
    return F.when(usable, F.struct(rtype.alias("resource_type"), rid.alias("id")))


def server_reference(reference: Column, base_url: Column) -> Column:
    """STRUCT<resource_type, id, url> of a reference on the same server, else null."""
    base = F.regexp_replace(base_url, "/$", "")
    absolute = F.lower(reference).rlike("^https?://")
    same = F.lower(reference).startswith(F.concat(F.lower(base), F.lit("/")))
    relative = (
        F.when(~absolute, F.regexp_replace(reference, "^/", ""))
        .when(same, reference.substr(F.length(base) + 2, F.length(reference)))
    )
    parts = F.filter(F.split(relative, "[/?#]"), lambda p: p != "")
    rtype, rid = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    url = F.concat(base, F.lit("/"), rtype, F.lit("/"), F.replace(F.url_encode(rid), F.lit("+"), F.lit("%20")))
    good = blank_to_null(reference).isNotNull() & rid.isNotNull() & rtype.rlike("^[A-Za-z]+$")
    return F.when(good, F.struct(rtype.alias("resource_type"), rid.alias("id"), url.alias("url")))
