"""Compare registered Spark queries with their DuckDB oracle SQL.

    python -m seqscore.plans.check [--sf DIR] [name ...]

Row count, column names, coarse types and order-insensitive values (floats at 6 digits).
"""

from __future__ import annotations

import argparse
import math
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


EXACT = False


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        if EXACT:
            return v
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _kind(t: str) -> str:
    t = t.lower()
    if any(x in t for x in ("int", "long", "short", "byte")):
        return "int"
    if any(x in t for x in ("double", "float", "decimal", "real")):
        return "float"
    if any(x in t for x in ("string", "varchar", "char")):
        return "str"
    if "bool" in t:
        return "bool"
    return t


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    scols = sdf.columns
    stypes = [_kind(f.dataType.simpleString()) for f in sdf.schema.fields]
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(sql)
    dcols = rel.columns
    dtypes = [_kind(str(t)) for t in rel.types]
    drows = rel.fetchall()
    res["oracle_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        res["status"] = f"COLUMNS spark={scols} oracle={dcols}"
        return res
    order_s = sorted(range(len(scols)), key=lambda i: scols[i])
    order_d = sorted(range(len(dcols)), key=lambda i: dcols[i])
    ts = [stypes[i] for i in order_s]
    td = [dtypes[i] for i in order_d]
    s_norm = sorted((tuple(_norm(r[i]) for i in order_s) for r in srows), key=repr)
    d_norm = sorted((tuple(_norm(r[i]) for i in order_d) for r in drows), key=repr)
    if len(srows) != len(drows):
        res["status"] = "ROWCOUNT"
    elif s_norm != d_norm:
        diff = [(a, b) for a, b in zip(s_norm, d_norm) if a != b][:3]
        res["status"] = f"VALUES {diff}"
    elif ts != td:
        res["status"] = f"TYPES spark={ts} oracle={td}"
    else:
        res["status"] = "ok"
    return res


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--exact", action="store_true", help="compare floats without rounding")
    ap.add_argument("--oracle-only", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    global EXACT
    EXACT = a.exact
    sys.path.insert(0, ".")
    from seqscore.plans import all_queries
    from seqscore.session import get_spark
    qs, oracle = all_queries()
    spark = get_spark("local[8]", 8)
    con = duck_connect(a.sf)
    names = a.names or [n for n in qs if not a.oracle_only or n in oracle]
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, qs[n], oracle.get(n), a.sf)
        except Exception as e:  # noqa: BLE001 - report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main())
