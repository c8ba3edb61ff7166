"""Links between records and between groups: explicit references, fixed-depth hops, group views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import json_fields as J
from ..functions.links import GROUPABLE_TYPES, local_reference
from ..functions.ranking import best_row, extreme_row, fan_out, one_or_several, top_k
from ..functions.text import fnv1a_base36, record_key
from ..session import saved

# Type, field, edge kind, label.
EDGE_RULES = [
    ("Observation", "encounter", "encounter", "Observed during visit"),
    ("Observation", "derivedFrom", "derived_from", "Derived from"),
    ("Observation", "hasMember", "has_member", "Includes result"),
    ("Observation", "basedOn", "based_on", "Ordered from"),
    ("DiagnosticReport", "encounter", "encounter", "Reported during visit"),
    ("DiagnosticReport", "result", "result", "Report result"),
    ("DiagnosticReport", "basedOn", "based_on", "Ordered from"),
    ("Encounter", "reasonReference", "reason", "Visit reason"),
    ("Encounter", "diagnosis[].condition", "diagnosis", "Visit diagnosis"),
    ("Encounter", "partOf", "part_of", "Part of visit"),
    ("Procedure", "encounter", "encounter", "Performed during visit"),
    ("Procedure", "reasonReference", "reason", "Procedure reason"),
    ("Procedure", "basedOn", "based_on", "Ordered from"),
    ("MedicationRequest", "encounter", "encounter", "Ordered during visit"),
    ("MedicationRequest", "reasonReference", "reason", "Medication reason"),
    ("MedicationRequest", "basedOn", "based_on", "Ordered from"),
    ("Immunization", "encounter", "encounter", "Given during visit"),
]


def _references(path: str) -> Column:
    body = F.col("body")
    if "[]." not in path:
        return J.references(body, path)
    outer, inner = path.split("[].")
    nested = J.field(body, outer, f"array<struct<{inner}:struct<reference:string>>>")
    refs = F.transform(F.coalesce(nested, F.array()), lambda e: e[inner]["reference"])
    return F.filter(refs, lambda r: F.nullif(r, F.lit("")).isNotNull())


def explicit_edges(resources: DataFrame) -> DataFrame:
    """Edges ``(source_id, patient_id, edge_id, src, dst, src_type, dst_type, kind, label)``.

    Both ends must exist in the same source; the record an edge starts from does by construction,
    so one semi join (on the target) is enough.
    """
    rows = resources.filter(F.col("resource_type").isin(*GROUPABLE_TYPES) & (F.trim("id") != ""))
    empty = F.array().cast("array<struct<kind:string,label:string,reference:string>>")

    def tagged(refs: Column, kind: str, label: str) -> Column:
        return F.transform(refs, lambda r: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), r.alias("reference")))

    rules = [F.when(F.col("resource_type") == rtype, tagged(_references(path), kind, label)).otherwise(empty) for rtype, path, kind, label in EDGE_RULES]
    # Bodies are read once: records without a reference keep a row, so the targets that exist come from the same narrow table.
    links = rows.select("source_id", "patient_id", "resource_type", F.trim("id").alias("id"), F.explode_outer(F.concat(*rules)).alias("_l"))
    # A generator over the parsed target evaluates it once; it is null where there is no usable reference.
    target = F.explode(F.array(local_reference(F.col("_l.reference")))).alias("_t")
    read = saved(links.select("*", target).select("source_id", "patient_id", "resource_type", "id", F.struct("_l.kind", "_l.label").alias("_l"), "_t"))
    edges = read.filter("_t is not null").select(
        "source_id",
        "patient_id",
        F.col("resource_type").alias("src_type"),
        F.col("_t.resource_type").alias("dst_type"),
        F.col("id").alias("src_id"),
        F.col("_t.id").alias("dst_id"),
        F.col("_l.kind").alias("kind"),
        F.col("_l.label").alias("label"),
    )
    edges = edges.filter((F.col("src_type") != F.col("dst_type")) | (F.col("src_id") != F.col("dst_id")))
    available = read.select("source_id", F.col("resource_type").alias("dst_type"), F.col("id").alias("dst_id"))
    kept = edges.join(available, ["source_id", "dst_type", "dst_id"], "left_semi").dropDuplicates(["source_id", "src_type", "src_id", "dst_type", "dst_id", "kind"])
    scoped = lambda t, i: record_key(F.col(t), F.concat(F.col("source_id"), F.lit(":"), F.col(i)))
    keyed = kept.withColumns({"src": scoped("src_type", "src_id"), "dst": scoped("dst_type", "dst_id")})
    return keyed.withColumn("edge_id", fnv1a_base36(F.concat_ws("|", "src", "dst", "kind"))).drop("src_id", "dst_id")


def adjacency(edges: DataFrame) -> DataFrame:
    """Every edge seen from both ends: ``(record_key, related_key, kind, label, ...)``."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "src_type", "dst_type")]
    ends = [F.struct(F.col(a).alias("record_key"), F.col(b).alias("related_key")) for a, b in (("src", "dst"), ("dst", "src"))]
    return edges.select(F.inline(F.array(*ends)), *rest)


def observation_conditions(edges: DataFrame) -> DataFrame:
    """Distinct ``(observation_key, condition_key)``: direct, through the visit, or through a report.

    Every edge takes its place in the paths by the types of its ends, whichever way it points. Visits and reports are the
    middle of a path: their conditions are made distinct before they meet the observations, in one join for both.
    """
    far = {  # (near end, far end, kinds that count): a step of a path
        "visit_condition": ("Encounter", "Condition", ["reason", "diagnosis"]),
        "report_condition": ("DiagnosticReport", "Condition", None),
        "report_visit": ("DiagnosticReport", "Encounter", ["encounter"]),
        "observation_condition": ("Observation", "Condition", None),
        "observation_visit": ("Observation", "Encounter", ["encounter"]),
        "observation_report": ("Observation", "DiagnosticReport", ["result"]),
    }
    place = F.lit(None).cast("struct<step:string,near:string,far:string>")
    for step, (a, b, kinds) in far.items():
        counts = F.col("kind").isin(*kinds) if kinds else F.lit(True)
        for near, other, start, end in ((a, b, "src", "dst"), (b, a, "dst", "src")):
            fits = (F.col("src_type") == near) & (F.col("dst_type") == other) & counts
            place = F.coalesce(place, F.when(fits, F.struct(F.lit(step).alias("step"), F.col(start).alias("near"), F.col(end).alias("far"))))
    steps = edges.select(F.inline(F.filter(F.array(place), lambda p: p.isNotNull())))
    of = lambda *names: steps.filter(F.col("step").isin(*names)).select("near", "far")
    visits = of("visit_condition").distinct()
    through_visit = of("report_visit").withColumnRenamed("far", "middle").join(visits.withColumnRenamed("near", "middle"), "middle").select("near", "far")
    middles = visits.unionByName(of("report_condition").unionByName(through_visit).distinct()).withColumnRenamed("near", "middle")
    met = of("observation_visit", "observation_report").withColumnRenamed("far", "middle").join(middles, "middle").select("near", "far")
    pairs = of("observation_condition").unionByName(met).distinct()
    return pairs.select(F.col("near").alias("observation_key"), F.col("far").alias("condition_key"))


def record_groups(members: DataFrame) -> DataFrame:
    """First group of every record: ``members(patient_id, group_id, group_pos, record_key, name)``."""
    return extreme_row(members, ["patient_id", "record_key"], ["group_pos", "group_id"], "min").select("patient_id", "record_key", "group_id", "name")


def explicit_group_links(members: DataFrame, adj: DataFrame, first_groups: DataFrame) -> DataFrame:
    """Links of a group to records outside it, distinct by (related record, kind)."""
    m = members.select("patient_id", "group_id", "record_key")
    own = m.withColumnRenamed("record_key", "related_key")
    links = m.join(adj.select("record_key", "related_key", "kind", "label"), "record_key").join(own, ["patient_id", "group_id", "related_key"], "left_anti")
    unique = links.groupBy("patient_id", "group_id", "related_key", "kind").agg(F.min("label").alias("label"))
    groups = first_groups.select("patient_id", F.col("record_key").alias("related_key"), F.col("group_id").alias("related_group_id"), F.col("name").alias("related_group_name"))
    return unique.join(groups, ["patient_id", "related_key"], "left")


def explicit_context(members: DataFrame, adj: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """The distinct 'edge label: related name' texts per group, in binary order; the first ``limit`` if that is given.

    ``labels(record_key, name)`` names a related record by its group, else by its own label.
    """
    m = members.select("patient_id", "group_id", "record_key")
    named = labels.select(F.col("record_key").alias("related_key"), F.col("name").alias("_name"))
    texts = m.join(adj.select("record_key", "related_key", "label"), "record_key").join(named, "related_key")
    distinct = texts.select("patient_id", "group_id", F.concat_ws(": ", "label", "_name").alias("context")).distinct()
    ranked = distinct.withColumn("context_pos", F.row_number().over(Window.partitionBy("patient_id", "group_id").orderBy("context")))
    return ranked if limit is None else top_k(distinct, ["patient_id", "group_id"], [F.col("context")], limit, "context_pos")


def suggested_links(group_edges: DataFrame, groups: DataFrame, transform_version: int, model: str | None) -> DataFrame:
    """Suggested group links seen from both ends: current version, allowed model, both groups present."""
    allowed = F.col("model").startswith("deterministic:")
    if model is not None:
        allowed = allowed | (F.col("model") == model)
    current = group_edges.filter((F.col("transform_version") == transform_version) & allowed & (F.col("relationship") != "none"))
    have = groups.select("patient_id", "group_key").distinct()
    both = current.join(have.withColumnRenamed("group_key", "source_group"), ["patient_id", "source_group"], "left_semi").join(
        have.withColumnRenamed("group_key", "target_group"), ["patient_id", "target_group"], "left_semi"
    )
    rest = [c for c in both.columns if c not in ("source_group", "target_group")]
    out = both.select(F.col("source_group").alias("group_key"), F.col("target_group").alias("related_group_key"), *rest)
    back = both.filter("source_group <> target_group").select(F.col("target_group").alias("group_key"), F.col("source_group").alias("related_group_key"), *rest)
    return out.unionByName(back)


def condition_match_keys(condition_groups: DataFrame) -> DataFrame:
    """The keys under which a condition group can be found: own code, code category, lower-case name.

    Only the first group of a key can win a match, so one row per key is enough.
    """
    from ..functions.coding import category_parent

    code, name = F.col("code"), F.lower(F.trim("name"))
    keys = F.array(
        F.struct(F.lit("code").alias("kind"), code.alias("key")),
        F.struct(F.lit("code").alias("kind"), category_parent(code).alias("key")),
        F.struct(F.lit("name").alias("kind"), name.alias("key")),
    )
    rows = condition_groups.select("patient_id", "group_key", "group_pos", F.explode(keys).alias("_k"))
    keyed = rows.select("patient_id", F.col("_k.kind").alias("kind"), F.col("_k.key").alias("key"), "group_pos", "group_key").filter("key is not null")
    return extreme_row(keyed, ["patient_id", "kind", "key"], ["group_pos", "group_key"], "min")


def first_matches(found: DataFrame, condition_groups: DataFrame) -> DataFrame:
    """First condition group that matches each code of a patient; whatever else ``found`` holds does not change it.

    A prefix match becomes two equi joins: the group offers its full code and its three-character category.
    """
    keys = F.array(
        F.struct(F.lit("code").alias("kind"), F.col("condition_code").alias("key")),
        F.struct(F.lit("name").alias("kind"), F.lower("condition_code").alias("key")),
    )
    codes = found.select("patient_id", "condition_code").distinct()
    wanted = codes.select("*", F.explode(keys).alias("_k")).select("patient_id", "condition_code", "_k.*")
    hits = wanted.join(condition_match_keys(condition_groups), ["patient_id", "kind", "key"]).drop("kind", "key")
    return extreme_row(hits, ["patient_id", "condition_code"], ["group_pos", "group_key"], "min")


def match_conditions(found: DataFrame, condition_groups: DataFrame, subject: list[str]) -> DataFrame:
    """First condition group that matches each associated code; ``found`` has ``patient_id``, the ``subject`` columns and ``condition_code``."""
    rows = found.select("patient_id", *subject, "condition_code").distinct()
    return rows.join(first_matches(found, condition_groups), ["patient_id", "condition_code"])


def group_condition_edges(found: DataFrame, condition_groups: DataFrame, source_type: str, relationship: str, model: str, transform_version: int, now_ms: int) -> DataFrame:
    """Deterministic group edges from ``found(patient_id, source_group, condition_code)``."""
    matched = found.join(first_matches(found, condition_groups), ["patient_id", "condition_code"])
    return matched.select("patient_id", "source_group", F.col("group_key").alias("target_group")).distinct().select(
        "patient_id",
        "source_group",
        "target_group",
        F.lit(source_type).alias("source_type"),
        F.lit("Condition").alias("target_type"),
        F.lit(relationship).alias("relationship"),
        F.lit(1.0).alias("confidence"),
        F.lit(False).alias("fallback"),
        F.lit(model).alias("model"),
        F.lit(transform_version).alias("transform_version"),
        F.lit(now_ms).cast("bigint").alias("updated_at"),
    )


def claim_medications(found: DataFrame, condition_groups: DataFrame) -> DataFrame:
    """Each medication group goes to the first associated condition that is present.

    ``found(patient_id, source_group, condition_code, assoc_pos)``; a code match outranks a name match
    of the same association.
    """
    keys = F.array(
        F.struct(F.lit("code").alias("kind"), F.col("condition_code").alias("key"), F.lit(0).alias("tier")),
        F.struct(F.lit("name").alias("kind"), F.lower("condition_code").alias("key"), F.lit(1).alias("tier")),
    )
    wanted = found.select("patient_id", "source_group", "assoc_pos", F.explode(keys).alias("_k")).select("patient_id", "source_group", "assoc_pos", "_k.*")
    hits = wanted.join(condition_match_keys(condition_groups), ["patient_id", "kind", "key"])
    best = extreme_row(hits, ["patient_id", "source_group"], ["assoc_pos", "tier", "group_pos", "group_key"], "min")
    return best.select("patient_id", F.col("source_group").alias("medication_group"), F.col("group_key").alias("condition_group"))


def related_groups(group_edges: DataFrame) -> DataFrame:
    """Lab and medication groups next to condition groups, from non-``none`` edges."""
    return group_edges.filter("relationship <> 'none' and target_type = 'Condition'").select(
        "patient_id", F.col("target_group").alias("condition_group"), F.col("source_group").alias("related_group"), F.col("source_type").alias("related_type")
    ).distinct()


def related_by_name(med_conditions: DataFrame, condition_groups: DataFrame) -> DataFrame:
    """Medication groups and condition groups joined by lower-case condition name.

    A pair can only be found twice where a condition group has several names; the other pairs are unique as they are joined.
    """
    left = med_conditions.select("patient_id", "medication_group", F.lower("condition_name").alias("_n")).distinct()
    right = condition_groups.select("patient_id", F.col("group_key").alias("condition_group"), F.lower("name").alias("_n"))
    one, several = one_or_several(right, ["patient_id", "condition_group"], "_n")
    pairs = lambda rows: fan_out(rows, left, ["patient_id", "_n"]).select("patient_id", "medication_group", "condition_group")
    return pairs(one).unionByName(pairs(several).distinct())


def recent_labs(latest: DataFrame, now_ms: int, days: int = 180) -> DataFrame:
    """``latest(patient_id, group_key, latest_date)`` whose age is within 0..days (fractions count)."""
    from ..functions.dates import MS_PER_DAY, millis

    age = (F.lit(now_ms) - millis(F.col("latest_date"))) / F.lit(float(MS_PER_DAY))
    return latest.withColumn("age_days", age).filter(F.col("age_days").between(0, days))


def claimed_labs(group_edges: DataFrame, latest: DataFrame, now_ms: int, days: int = 180) -> DataFrame:
    owned = group_edges.filter("relationship <> 'none' and target_type = 'Condition'").select("patient_id", F.col("source_group").alias("group_key"))
    return recent_labs(latest, now_ms, days).join(owned, ["patient_id", "group_key"], "left_semi")


def unclaimed(groups: DataFrame, claims: DataFrame) -> DataFrame:
    return groups.join(claims.select("patient_id", "group_key"), ["patient_id", "group_key"], "left_anti")


def inline_lab(group_edges: DataFrame, latest: DataFrame, now_ms: int, days: int = 180) -> DataFrame:
    """Most recent claimed lab per condition: out-of-range ones first where ``latest`` carries the flag."""
    labs = recent_labs(latest, now_ms, days).withColumnRenamed("group_key", "related_group")
    pairs = related_groups(group_edges).filter("related_type = 'Observation'").join(labs, ["patient_id", "related_group"])
    order = [F.col("age_days"), F.col("related_group")]
    if "out_of_range" in latest.columns:
        order.insert(0, F.coalesce("out_of_range", F.lit(False)).desc())
    return best_row(pairs, ["patient_id", "condition_group"], order)


def latest_related(group_edges: DataFrame, latest: DataFrame, k: int = 3) -> DataFrame:
    """Per condition the ``k`` related lab groups with the newest values."""
    labs = latest.withColumnRenamed("group_key", "related_group")
    pairs = related_groups(group_edges).filter("related_type = 'Observation'").join(labs, ["patient_id", "related_group"], "left")
    return top_k(pairs, ["patient_id", "condition_group"], [F.coalesce("latest_date", F.lit("")).desc(), F.col("related_group")], k, "lab_rank")
