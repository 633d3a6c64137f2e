"""Compare registered Spark queries against their DuckDB oracle statements.

Used by the tests and by hand (``python -m revcast.plans.check sf_dir [names]``).
Comparison: column names (sorted), row count, and the multiset of rows with
exact values (floats compared bit-for-bit after normalising -0.0 and NaN).
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import sys
import time


ORACLE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in ORACLE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, repr(v)) for v in row)


def compare(spark, sf_dir: str, name: str, con=None, tol: float | None = None) -> dict:
    from .registry import ORACLE, QUERIES
    con = con or duckdb_connection(sf_dir)
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    srows = sdf.collect()
    t_spark = time.time() - t0
    scols = list(sdf.columns)
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t_spark, 2)}
    if name not in ORACLE:
        res["status"] = "rows-only"
        return res
    cur = con.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    res["duck_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        res["status"] = f"COLUMNS spark={sorted(scols)} duck={sorted(dcols)}"
        return res
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in srows), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in drows), key=_key)
    if len(a) != len(b):
        res["status"] = "ROWCOUNT"
        return res
    bad = 0
    first = None
    for x, y in zip(a, b):
        if x != y:
            ok = tol is not None and all(
                (u == v) or (isinstance(u, float) and isinstance(v, float)
                             and abs(u - v) <= tol * max(1.0, abs(v)))
                for u, v in zip(x, y))
            if not ok:
                bad += 1
                first = first or (x, y)
    res["status"] = "OK" if bad == 0 else f"VALUES {bad} rows differ; first {first}"
    return res


def main(argv):
    from .. import plans  # noqa: F401  (registers every query)
    from ..session import get_spark
    from .registry import QUERIES
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or sorted(QUERIES)
    spark = get_spark()
    con = duckdb_connection(sf_dir)
    for n in names:
        try:
            r = compare(spark, sf_dir, n, con)
        except Exception as e:  # report and continue with the next query
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        print(r, flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
