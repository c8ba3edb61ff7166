"""Group-wise picks that stay safe when one key holds a large share of the rows.

``latest_row`` is an aggregate, so Spark combines it before the shuffle. ``top_k`` keeps the plain
``row_number() <= k`` form on its own: Spark then cuts every group to k rows per input partition
(WindowGroupLimit) before anything is exchanged, and a hot group costs k rows per task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_best").drop("_best")


def extreme_row(df: DataFrame, keys: list[str], order: list[str], pick: str = "max") -> DataFrame:
    """The row with the largest (smallest) ``order`` tuple per key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    agg = F.max(packed) if pick == "max" else F.min(packed)
    return df.groupBy(*keys).agg(agg.alias("_row")).select(*keys, "_row.*")


def one_or_several(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """The distinct rows ``(keys, value)`` of the keys with one value, and those of the keys with several. Nulls are left out."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_least"), F.max(value).alias("_most"))
    one = ends.filter("_least = _most").select(*keys, F.col("_least").alias(value))
    repeated = ends.filter("_least < _most").select(*[F.col(k).alias(f"_of_{k}") for k in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    several = df.join(repeated, same, "left_semi").filter(F.col(value).isNotNull())
    return one, several.select(*keys, value).distinct()


def slots_of(n_rows: Column, slots: int = 16, full: int = 4096) -> Column:
    """Slots of a value that ``n_rows`` rows hold: one for up to ``full`` rows, so that its part of a table is only repeated where that is needed."""
    return F.least(F.lit(slots), F.ceil(n_rows / full)).cast("int")


def dealt(rows: DataFrame, on: list[str], slots: Column) -> DataFrame:
    """Each row in one ``_slot`` of its value."""
    rest = [c for c in rows.columns if c not in on]
    return rows.withColumn("_slot", F.pmod(F.xxhash64(*rest), slots).cast("int"))


def repeated(table: DataFrame, slots: Column) -> DataFrame:
    """Each row in every ``_slot`` of its value."""
    return table.withColumn("_slot", F.explode(F.sequence(F.lit(0), slots - 1)))


def fan_out(rows: DataFrame, table: DataFrame, on: list[str], slots: int = 16) -> DataFrame:
    """Inner join where one value of ``on`` can hold many rows of both sides.

    The rows of a value are dealt to ``slots``, its part of the table is repeated in each, so one value is joined by many tasks. The dealt
    rows are what a task holds; they come in one order for each row of the table, which a columnar file packs well. The number of
    partitions is fixed, since small inputs with a large result would else be coalesced into one task.
    """
    spark = rows.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = [*on, "_slot"]
    left, right = repeated(table, F.lit(slots)), dealt(rows, on, F.lit(slots))
    return left.repartition(parts, *place).join(right.repartition(parts, *place), place).drop("_slot")


def order_statistics(df: DataFrame, keys: list[str], value: str, picks: dict[str, Column], slots: int = 256) -> DataFrame:
    """Exact values at zero-based positions of the sorted values of each key.

    ``picks`` maps an output column to a position expression over ``n`` (the count of the key). Values are counted per distinct
    value. The distinct values of a key are cut at their own approximate quantiles, so a slot holds about one in ``slots`` of
    them however they are spread, and a value that occurs often stays one row. Only a slot that holds a position is ranked.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    shares = F.lit([n / slots for n in range(1, slots)]).cast("array<double>")
    spans = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), F.percentile_approx(value, shares, F.lit(20 * slots)).alias("_borders"))
    # The slot of a value is the number of borders below it: a coarse search over every ``step``-th border, then a fine one.
    step = math.isqrt(slots)
    coarse = F.filter("_borders", lambda b, n: n % step == 0)
    searched = counts.join(spans.select(*keys, "_borders", coarse.alias("_coarse")), keys)
    searched = searched.withColumn("_from", F.greatest(F.size(F.filter("_coarse", lambda b: b < F.col(value))) - 1, F.lit(0)) * step)
    fine = F.filter(F.slice("_borders", F.col("_from") + 1, step), lambda b: b < F.col(value))
    placed = searched.withColumn("_slot", F.col("_from") + F.size(fine)).drop("_borders", "_coarse", "_from")
    per_slot = placed.groupBy(*keys, "_slot").agg(F.sum("_c").alias("_slot_n"))
    before = F.sum("_slot_n").over(Window.partitionBy(*keys).orderBy("_slot")) - F.col("_slot_n")
    starts = per_slot.withColumn("_before", before)
    targets = F.array(*[F.struct(F.lit(name).alias("name"), pos.cast("bigint").alias("pos")) for name, pos in picks.items()])
    wanted = spans.select(*keys, F.explode(targets).alias("_t")).select(*keys, F.col("_t.name").alias("_name"), F.col("_t.pos").alias("_pos"))
    hit = wanted.join(starts, keys).filter((F.col("_pos") >= F.col("_before")) & (F.col("_pos") < F.col("_before") + F.col("_slot_n")))
    inside = placed.select(*keys, "_slot", value, "_c").join(hit.select(*keys, "_slot", "_name", "_pos", "_before"), [*keys, "_slot"])
    running = F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy(value))
    found = (
        inside.withColumn("_upto", F.col("_before") + running)
        .filter((F.col("_pos") < F.col("_upto")) & (F.col("_pos") >= F.col("_upto") - F.col("_c")))
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in picks])
    )
    return found
