"""Registry of checked queries: a Spark callable and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


class Tables:
    """The given tables of one scale folder, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def heavy(self, name: str) -> DataFrame:
        """A table whose rows are about to be worked on at length."""
        return spread(read_table(self._spark, self._dir, name))

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self._spark, self._dir, name)


def iso_seconds(ts: Column | str) -> Column:
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy-MM-dd'T'HH:mm:ss")


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def pick(index: Column, *options: str | None) -> Column:
    """Option number ``index`` (0-based) as a CASE, the same in both engines."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for n, option in enumerate(options):
        out = out.when(index == n, F.lit(option).cast("string"))
    return out


def sql_pick(index: str, *options: str | None) -> str:
    quoted = ["NULL" if o is None else "'" + o.replace("'", "''") + "'" for o in options]
    return "CASE " + " ".join(f"WHEN ({index}) = {n} THEN {q}" for n, q in enumerate(quoted)) + " END"
