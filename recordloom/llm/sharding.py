"""Shards by a hierarchical weighted hash tree of regions, racks and shards.

At every node each child draws an exponential number out of the key, the child's path and its weight; the smallest draw wins,
so a child gets its share of the weight of its siblings. A key's draw for a node does not depend on other nodes: where a weight
changes, keys move only into or out of that node, and only inside the subtrees on its path. A new region takes keys from all
others and moves none between them.

Results for odd input: a null text has size 1 and checksum 0; null keys draw like one key; repeated rows go to one shard and
get slots of their own; ties of draws go to the first name; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

LEVELS = ("region", "rack", "shard")
ROOT = ""
SHARDS, PER_RACK, RACKS = 8, 2, 2

Tree = dict[str, dict[str, dict[str, float]]]


def balanced_tree(shards: int, per_rack: int = PER_RACK, racks: int = RACKS) -> Tree:
    """Regions of racks of shards, filled in order; every shard has weight 1."""
    tree: Tree = {}
    for shard in range(shards):
        rack = shard // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[str(shard)] = 1.0
    return tree


def grown_tree(shards: int) -> Tree:
    """The balanced tree of SHARDS shards; every further shard opens a region of its own, so a new one takes keys into itself alone."""
    tree = balanced_tree(min(shards, SHARDS))
    for n in range(SHARDS, shards):
        tree[f"region{len(tree)}"] = {f"rack{SHARDS // PER_RACK + n - SHARDS}": {str(n): 1.0}}
    return tree


def children(tree: Tree) -> dict[str, list[dict]]:
    """For each path its children with their weights; the weight of a node is that of its shards. Weightless nodes get nothing."""
    found: dict[str, list[dict]] = {}

    def weigh(path: str, node) -> float:
        if not isinstance(node, dict):
            return float(node)
        kids = [{"path": f"{path}/{name}", "name": name, "weight": weigh(f"{path}/{name}", kid)} for name, kid in sorted(node.items())]
        found[path] = [k for k in kids if k["weight"] > 0]
        return sum(k["weight"] for k in kids)

    if weigh(ROOT, tree) <= 0:
        raise ValueError("the tree has no weight")
    return found


def draw(key: Column, path: Column, weight: Column) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, path), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(unit) / weight


def descend(key: Column, tree: Tree) -> list[Column]:
    """The chosen region, rack and shard of a key."""
    kids = F.from_json(F.lit(json.dumps(children(tree))), "map<string,array<struct<path:string,name:string,weight:double>>>")
    path, chosen = F.lit(ROOT), []
    for level in LEVELS:
        drawn = F.transform(F.element_at(kids, path), lambda kid: F.struct(draw(key, kid["path"], kid["weight"]).alias("draw"), kid["name"].alias("name"), kid["path"].alias("path")))
        winner = F.array_min(drawn)
        chosen.append(winner["name"].alias(level))
        path = winner["path"]
    return chosen


def place(docs: DataFrame, tree: Tree, key: str = "doc_id") -> DataFrame:
    """``docs`` with the columns region, rack and shard; given columns of these names are replaced."""
    return docs.withColumns(dict(zip(LEVELS, descend(F.col(key), tree), strict=True)))


def numbered(rows: DataFrame, group: str, into: str) -> DataFrame:
    """``rows`` with a gapless number from 0 within each group, whatever the size of a group.

    Rows are numbered inside the parts in which they are stored, and counts of parts give where each part starts.
    """
    kept = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_row", 33))
    counts = kept.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_part").orderBy("_row")
    within = kept.withColumn("_at", F.row_number().over(inside) - 1)
    return within.join(starts, [group, "_part"]).withColumn(into, (F.col("_start") + F.col("_at")).cast("long")).drop("_row", "_part", "_n", "_start", "_at")


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard, slot in it, and the shard with one more, per document; the law holds from SHARDS shards on."""
    if shards < SHARDS:
        raise ValueError(f"the law of the key holds from {SHARDS} shards on")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(F.col("doc_id"), grown_tree(shards))[-1].cast("int").alias("shard"),
        descend(F.col("doc_id"), grown_tree(shards + 1))[-1].cast("int").alias("grown_shard"),
    )
    return numbered(rows, "shard", "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
