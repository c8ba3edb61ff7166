"""Run registered queries next to their SQL: ``python tests/oracle_check.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows: list[tuple]) -> list[tuple]:
    def cell(v):
        if isinstance(v, float) and math.isnan(v):
            return ("nan",)
        return ("",) if v is None else (type(v).__name__, v)

    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


def compare(spark, sf_dir: str, name: str, query, sql: str | None) -> tuple[bool, str]:
    import duckdb

    t0 = time.time()
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    t1 = time.time()
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {t1 - t0:.1f}s"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return False, f"columns differ: {cols} / {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in rel.fetchall()]
    a, b = canonical(got), canonical(want)
    note = f"{len(got)} rows, spark {t1 - t0:.1f}s, sql {time.time() - t1:.1f}s"
    if a == b:
        return True, note
    only_a = [x for x in a if x not in set(b)][:3] if len(a) < 200000 else []
    only_b = [x for x in b if x not in set(a)][:3] if len(b) < 200000 else []
    return False, f"{note}; rows {len(a)} / {len(b)}\n   spark {cols}: {only_a}\n   sql: {only_b}"


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    import __spark_entry__ as entry
    from recordloom.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.log.structuredLogging.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not names or any(n.startswith(p) for p in names)]
    bad = 0
    for name in chosen:
        try:
            ok, note = compare(spark, sf_dir, name, queries[name], oracles.get(name))
        except Exception as err:
            ok, note = False, f"{type(err).__name__}: {str(err)[:500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + note[:1200], flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")


if __name__ == "__main__":
    main()
