"""Resolving references between resources, and finding the ones that lead nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import json_fields as J
from ..functions.links import server_reference
from ..functions.ranking import top_k
from ..sources.scopes import scope_allows

# References whose target is needed to show a record: type, field, is a list, reason.
DISPLAY_REFERENCES = [
    ("MedicationRequest", "medicationReference", False, "MedicationRequest display can require referenced Medication"),
    ("MedicationStatement", "medicationReference", False, "MedicationStatement display can require referenced Medication"),
    ("Encounter", "reasonReference", True, "Encounter reason can reference a Condition"),
    ("Encounter", "serviceProvider", False, "Encounter display can reference a service organization"),
    ("DiagnosticReport", "result", True, "DiagnosticReport result can reference Observations"),
    ("DiagnosticReport", "encounter", False, "DiagnosticReport context can reference an Encounter"),
    ("DiagnosticReport", "performer", True, "DiagnosticReport display can reference performer organizations or practitioners"),
    ("Procedure", "encounter", False, "Procedure context can reference an Encounter"),
    ("Procedure", "reasonReference", True, "Procedure reason can reference a Condition"),
    ("Observation", "encounter", False, "Observation context can reference an Encounter"),
]


def resource_index(resources: DataFrame, types: list[str] | None = None, fields: dict[str, Column] | None = None) -> DataFrame:
    """``(source_id, key, resource_type, id)`` and ``fields`` (``body`` if none are named) with ``key = Type/id``; the last of equal keys wins.

    The fields are read before the rows are grouped, so whole bodies are not exchanged for the sake of a few of their values.
    """
    rows = resources.filter("id is not null and id <> '' and resource_type is not null")
    if types:
        rows = rows.filter(F.col("resource_type").isin(*types))
    values = F.struct(*[c.alias(name) for name, c in (fields or {"body": F.col("body")}).items()])
    small = rows.select("source_id", "resource_type", "id", "input_pos", values.alias("_values"))
    last = small.groupBy("source_id", "resource_type", "id").agg(F.max_by("_values", "input_pos").alias("_values"))
    return last.select("source_id", F.concat_ws("/", "resource_type", "id").alias("key"), "resource_type", "id", "_values.*")


def resolve_references(refs: DataFrame, index: DataFrame, base_url: Column | None = None) -> DataFrame:
    """Left equi join of ``refs(source_id, reference, ...)`` to an index keyed ``(source_id, key)``.

    Plain keys match as they are. With ``base_url``, absolute and slash-led references of the same
    server are brought to the same key first, so the join stays a single equality.
    """
    key = F.col("reference")
    if base_url is not None:
        parsed = server_reference(F.col("reference"), base_url)
        key = F.coalesce(F.concat_ws("/", parsed["resource_type"], parsed["id"]), key)
        key = F.when(parsed.isNull(), F.col("reference")).otherwise(key)
    return refs.withColumn("key", key).join(index, ["source_id", "key"], "left")


def display_references(resources: DataFrame) -> DataFrame:
    """One row per display reference, in record, rule and list order (``ref_pos``)."""
    body = F.col("body")

    def tagged(refs: Column, n: int, why: str) -> Column:
        return F.transform(refs, lambda r, i: F.struct(F.lit(n).alias("rule"), i.alias("item"), r.alias("reference"), F.lit(why).alias("reason")))

    rules = [
        F.when(F.col("resource_type") == rtype, tagged(J.references(body, name, only_list=many), n, why)).otherwise(
            F.array().cast("array<struct<rule:int,item:int,reference:string,reason:string>>")
        )
        for n, (rtype, name, many, why) in enumerate(DISPLAY_REFERENCES)
    ]
    wanted = sorted({r[0] for r in DISPLAY_REFERENCES})
    rows = resources.filter(F.col("resource_type").isin(*wanted)).select("source_id", "patient_id", "input_pos", F.explode(F.concat(*rules)).alias("_r"))
    return rows.select("source_id", "patient_id", "input_pos", "_r.*")


def missing_references(refs: DataFrame, present: DataFrame, base_url: Column, scope: Column, max_references: int | None = None) -> DataFrame:
    """References whose target is not among ``present(source_id, resource_type, id)``.

    First-seen order decides which of several equal targets is kept and which ones fall under the
    limit per source, if a client sets one; ``skipped`` marks those the scope forbids or that exceed it.
    """
    target = server_reference(F.col("reference"), base_url)
    parsed = refs.withColumn("_t", target).filter("_t is not null").withColumns(
        {"target_type": F.col("_t.resource_type"), "target_id": F.col("_t.id"), "url": F.col("_t.url")}
    ).drop("_t")
    index = present.select("source_id", F.col("resource_type").alias("target_type"), F.col("id").alias("target_id"))
    dangling = parsed.join(index, ["source_id", "target_type", "target_id"], "left_anti")
    order = F.struct("input_pos", "rule", "item")
    first = dangling.groupBy("source_id", "target_type", "target_id").agg(
        F.min(F.struct(order.alias("seen"), "reference", "url", "reason", scope.alias("scope"))).alias("_f")
    ).select("source_id", "target_type", "target_id", "_f.*")
    judged = first.withColumn("readable", scope_allows(F.col("scope"), F.col("target_type"), allow_when_unknown=False))
    if max_references is None:
        return judged.select("source_id", "target_type", "target_id", "reference", "url", "reason", (~F.col("readable")).alias("skipped"))
    in_limit = top_k(judged.filter("readable"), ["source_id"], [F.col("seen")], max_references).select("source_id", "target_type", "target_id", F.lit(False).alias("_within"))
    return judged.join(in_limit, ["source_id", "target_type", "target_id"], "left").select(
        "source_id", "target_type", "target_id", "reference", "url", "reason", F.coalesce("_within", F.lit(True)).alias("skipped")
    )
