"""Connected components of a graph given by its links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that stands in ``links`` (a, b); root is the smallest node reachable.

    Each round hangs the larger neighbours of every node, and then the node with its smaller neighbours, on the smallest
    neighbour. Links keep their number or get fewer, and the number of rounds grows with the logarithm of the longest path.
    The driver sees one count and one sum a round.
    """
    state = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        now = state.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
        if now == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select("b", "b").distinct())
        before = now
        both = state.union(state.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, large["a"] == least["u"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("link"))
        state = stored(small.select("link.a", "link.b").where("a <> b").distinct(), "links")
