import math
import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from recordloom.llm import sharding as H


def plain_leaf(key, tree):
    """Descend with the same draws: XXH64 of the key, and of the path with that as seed."""
    seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    kids, path = H.children(tree), ""
    while path in kids:
        draws = []
        for kid in kids[path]:
            unit = ((xxhash.xxh64_intdigest(kid["path"].encode(), seed) >> 11) + 0.5) * 2.0**-53
            draws.append((-math.log(unit) / kid["weight"], kid["name"], kid["path"]))
        path = min(draws)[2]
    return int(path.rsplit("/", 1)[1])


def test_report_follows_the_law(docs, texts, none, same):
    rows = H.shard_report(docs).collect()
    small, grown = H.balanced_tree(8), H.balanced_tree(9)
    expected = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", plain_leaf(i, small), plain_leaf(i, grown)) for i, t in texts]
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows), key=repr) == sorted(expected, key=repr)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert H.shard_report(none).count() == 0


def test_weights_share_keys_and_changes_stay_in_their_subtree(spark):
    tree = {"a": {"r": {"0": 1.0, "1": 3.0}, "s": {"2": 2.0}}, "b": {"t": {"3": 2.0, "4": 0.0}}}
    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r.shard for r in H.place(keys, tree).collect()}
    count = Counter(before.values())
    assert set(count) == {"0", "1", "2", "3"}
    for shard, weight in {"0": 1, "1": 3, "2": 2, "3": 2}.items():
        assert abs(count[shard] / 20000 - weight / 8) < 0.015
    tree["b"]["t"]["3"] = 4.0
    after = {r.doc_id: r.shard for r in H.place(keys, tree).collect()}
    assert {after[k] for k in after if after[k] != before[k]} == {"3"}


def test_slots_do_not_depend_on_the_size_of_a_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g")).repartition(7)
    found = defaultdict(list)
    for r in H.numbered(rows, "g", "n").collect():
        found[r.g].append(r.n)
    assert all(sorted(n) == list(range(len(n))) for n in found.values())


def test_every_further_shard_takes_rows_into_itself_alone(spark):
    docs = spark.range(700).selectExpr("id as doc_id", "cast(id as string) as text", "'old' as shard")
    for shards in (8, 9, 10, 11):
        moved = [r for r in H.shard_report(docs, shards).collect() if r.shard != r.grown_shard]
        assert moved and {r.grown_shard for r in moved} == {shards}
    placed = H.place(docs, H.grown_tree(9))
    assert placed.columns == ["doc_id", "text", "shard", "region", "rack"] and placed.where("shard = 'old'").count() == 0
