"""Provider directory: search, distance, flattening of endpoints, option lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import haversine_miles
from ..functions.text import blank_to_null, tokens_all_match

# Points of the relevance score, the verified threshold and the defaults of option order.
HAS_ENDPOINT, NAME_OR_ID_EQUAL, NAME_CONTAINS, ORGANISATION_CONTAINS, BRAND_CONTAINS = 20, 100, 60, 35, 30
VERIFIED_CONFIDENCE, MISSING_RANK, MIN_QUERY_LENGTH = 0.9, 99, 2
TEXT_FIELDS = (
    "display_name", "npi", "provider_type", "specialty", "specialty_terms", "zip5", "state", "practice_line1", "practice_city",
    "practice_state", "practice_zip5", "practice_organization_names",
)
ENDPOINT_FIELDS = ("access_brand", "raw_access_brand", "brand_family", "fhir_base_url", "evidence_path_class", "match_method")
# Allowed columns of an endpoint option.
ENDPOINT_TYPE = (
    "struct<access_brand:string,fhir_base_url:string,confidence:double,match_method:string,evidence:string,raw_access_brand:string,"
    "brand_family:string,patient_display_priority:int,evidence_path_class:string,candidate_rank:int>"
)


def search_text() -> Column:
    """Everything a query is matched against; blanks stand in for missing parts."""
    empty = F.lit("")
    own = [F.coalesce(F.col(f), empty) for f in TEXT_FIELDS]
    nested = F.flatten(F.transform("endpoint_options", lambda e: F.array(*[F.coalesce(e[f], empty) for f in ENDPOINT_FIELDS])))
    return F.lower(F.trim(F.array_join(F.concat(F.array(*own), nested), " ")))


def infer_vendor(base_url: Column, brand: Column) -> Column:
    value = F.lower(F.concat_ws(" ", F.coalesce(base_url, F.lit("")), F.coalesce(brand, F.lit(""))))
    has = lambda w: F.contains(value, F.lit(w))
    return F.when(has("cerner") | has("oracle"), "cerner").when(has("epic") | has("mychart"), "epic").otherwise("unknown")


def relevance(query: str) -> Column:
    q = F.lit(query.strip().lower())
    name = F.lower(F.trim("display_name"))
    points = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    return (
        points(F.size("endpoint_options") > 0, HAS_ENDPOINT)
        + points((name == q) | (F.col("npi") == q), NAME_OR_ID_EQUAL)
        + points(F.contains(name, q), NAME_CONTAINS)
        + points(F.contains(F.lower(F.trim(F.coalesce("practice_organization_names", F.lit("")))), q), ORGANISATION_CONTAINS)
        + points(F.exists("endpoint_options", lambda e: F.contains(F.lower(F.trim(e["access_brand"])), q)), BRAND_CONTAINS)
    )


def with_distance(records: DataFrame, origin: tuple[float, float] | None) -> DataFrame:
    if origin is None:
        return records.withColumn("distance_miles", F.lit(None).cast("double"))
    return records.withColumn("distance_miles", haversine_miles(F.lit(origin[0]), F.lit(origin[1]), F.col("lat"), F.col("lon")))


def flatten_endpoints(records: DataFrame) -> DataFrame:
    """Provider x endpoint; a provider without endpoint gives one provider-only row."""
    rows = records.select("*", F.posexplode_outer("endpoint_options").alias("option_pos", "_e")).drop("endpoint_options")
    e = F.col("_e")
    none = e.isNull()
    city = F.concat_ws(", ", blank_to_null(F.col("practice_city")), blank_to_null(F.col("practice_state")))
    place = F.concat_ws(" ", blank_to_null(F.col("practice_line1")), blank_to_null(city), F.coalesce(blank_to_null(F.col("practice_zip5")), blank_to_null(F.col("zip5"))))
    location = F.coalesce(blank_to_null(place), F.concat_ws(", ", blank_to_null(F.col("zip5")), blank_to_null(F.col("state"))))
    return rows.withColumns(
        {
            "id": F.concat(F.lit("directory-"), "npi", F.lit("-"), F.when(none, "provider").otherwise(F.col("option_pos").cast("string"))),
            "vendor": F.when(none, "unknown").otherwise(infer_vendor(e["fhir_base_url"], e["access_brand"])),
            "fhir_base_url": F.when(none, "").otherwise(e["fhir_base_url"]),
            "endpoint_status": F.when(none, "provider_only").when(e["confidence"] >= VERIFIED_CONFIDENCE, "verified").otherwise("candidate"),
            "access_brand": F.when(none, "Portal unknown").otherwise(e["access_brand"]),
            "confidence": F.when(none, 0.0).otherwise(e["confidence"]),
            "patient_display_priority": e["patient_display_priority"],
            "candidate_rank": e["candidate_rank"],
            "evidence": F.when(none, "No FHIR endpoint association is available yet for this provider.").otherwise(e["evidence"]),
            "location": location,
        }
    ).drop("_e")


def search(records: DataFrame, query: str, sort: str = "name", origin: tuple[float, float] | None = None, limit: int = 50) -> DataFrame:
    """Best providers for a query, flattened; the limit counts providers, and each keeps all its options.

    The order is global, so Spark keeps ``limit`` rows per task and merges those (TakeOrderedAndProject).
    """
    if len(query.strip()) < MIN_QUERY_LENGTH:
        return flatten_endpoints(with_distance(records.limit(0), origin))
    found = with_distance(records.filter(tokens_all_match(search_text(), query)), origin).withColumn("relevance", relevance(query))
    order = [F.col("relevance").desc(), F.col("display_name"), F.col("npi")]
    if sort == "distance" and origin is not None:
        order.insert(0, F.col("distance_miles").asc_nulls_last())
    top = found.orderBy(*order).limit(limit)
    return flatten_endpoints(top).orderBy(*order, F.col("option_pos"))


def zip_centroid(records: DataFrame, zip5: str | None = None) -> DataFrame:
    """Mean position per ZIP code (of one code, if given)."""
    rows = records.filter("lat is not null and lon is not null")
    rows = rows.filter(F.col("zip5") == zip5) if zip5 else rows
    return rows.groupBy("zip5").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("n"))


def find_provider(ids: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of generated ids such as ``directory-123-0`` or ``directory-123-provider``."""
    wanted = ids.select("id", F.regexp_extract("id", r"^directory-(\d+)-(?:\d+|provider)$", 1).alias("npi")).filter("npi <> ''").distinct()
    flat = flatten_endpoints(with_distance(records.join(wanted.select("npi").distinct(), "npi", "left_semi"), None))
    return flat.join(wanted.select("id"), "id", "left_semi")


def option_order(status: Column) -> list[Column]:
    return [
        (status == "provider_only").cast("int").asc(), F.coalesce("patient_display_priority", F.lit(MISSING_RANK)).asc(),
        F.coalesce("candidate_rank", F.lit(MISSING_RANK)).asc(), F.coalesce("confidence", F.lit(0.0)).desc(), F.col("access_brand").asc(),
    ]


def group_options(providers: DataFrame, key: str = "npi") -> tuple[DataFrame, DataFrame]:
    """Providers with their number of options, and the options in display order (``option_rank``).

    A provider has few endpoints, so the rank is a window over one provider.
    """
    from pyspark.sql import Window

    groups = providers.groupBy(key).agg(F.min("display_name").alias("name"), F.min("specialty").alias("specialty"), F.min("distance_miles").alias("distance_miles"), F.count(F.lit(1)).alias("n_options"))
    ranked = providers.withColumn("option_rank", F.row_number().over(Window.partitionBy(key).orderBy(*option_order(F.col("endpoint_status")), "id")))
    return groups, ranked


def coding_option_search(options: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """Options whose name, technical name or code hold every token; best score first.

    Every option is looked at: the source's early stop of the scan is not copied, as rows have no order here.
    """
    from ..functions.text import norm_text

    q = " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in query.lower()).split())
    name, technical, code = norm_text(F.col("name")), norm_text(F.col("technical_name")), norm_text(F.col("code"))
    hay = F.concat_ws(" ", name, technical, code)
    score = (
        F.when(name.startswith(q), 0.0).otherwise(20.0) + F.when(technical.startswith(q), 2.0).otherwise(0.0)
        + F.when(code == q, -5.0).otherwise(0.0) + F.least(F.length(technical), F.lit(240)) / 1000
    )
    hits = options.filter(tokens_all_match(hay, q) & F.lit(len(q) >= 2)).withColumn("score", score)
    return hits.orderBy("score", "name", "code").limit(limit)
