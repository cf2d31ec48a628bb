"""Run each registered query in Spark and its oracle SQL in DuckDB, compare
row count, column names and an order-insensitive multiset of rows.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__file__)))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in records)


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = list(sdf.columns)
    t1 = time.time()
    out = {"name": name, "rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    out["oracle_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        out["status"] = f"COLUMNS spark={sorted(scols)} duck={sorted(dcols)}"
        return out
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a == b:
        out["status"] = "ok"
    else:
        out["status"] = "MISMATCH"
        out["spark_only"] = list((a - b).elements())[:3]
        out["duck_only"] = list((b - a).elements())[:3]
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from moodframe.session import local_session

    spark = local_session(8)
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        try:
            res = compare(spark, sf_dir, name, qs[name], orc.get(name), con)
        except Exception as exc:  # noqa: BLE001
            res = {"name": name, "status": f"ERROR {type(exc).__name__}: {str(exc)[:600]}"}
        if res["status"] not in ("ok", "rows-only"):
            bad += 1
        print(res, flush=True)
    print(f"bad={bad} total={len(names or qs)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
