"""Run a registered Spark query and its DuckDB twin and compare them the way
the driver does: row count, column names, order-insensitive value hash."""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb
import numpy as np

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, dict):
        return tuple((k, _norm(v[k], digits)) for k in sorted(v))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True), digits)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, (np.floating, float)):
        f = float(v)
        if math.isnan(f):
            return None
        return round(f, digits)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    return v


def rows_hash(cols, rows, digits=6):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    normed = sorted(repr(tuple(_norm(r[i], digits) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(normed).encode()).hexdigest(), normed


def compare(spark, name, fn, sql, sf_dir, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    sh, sn = rows_hash(scols, srows)
    dh, dn = rows_hash(dcols, drows)
    out = {
        "query": name,
        "rows": (len(srows), len(drows)),
        "cols_match": sorted(scols) == sorted(dcols),
        "hash_match": sh == dh,
        "spark_s": round(t1 - t0, 2),
        "duck_s": round(t2 - t1, 2),
    }
    if not out["cols_match"]:
        out["cols"] = (sorted(scols), sorted(dcols))
    if not out["hash_match"]:
        ds, dd = set(sn), set(dn)
        out["only_spark"] = [x[:300] for x in sorted(ds - dd)[:2]]
        out["only_duck"] = [x[:300] for x in sorted(dd - ds)[:2]]
    return out


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from chatlore.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    names = argv or sorted(E.queries())
    spark = local_session(8)
    con = duck(sf_dir)
    sqls = E.oracle_sql()
    qs = E.queries()
    bad = 0
    for n in names:
        if n not in sqls:
            rows = qs[n](spark, sf_dir).count()
            print({"query": n, "rows_only": rows}, flush=True)
            continue
        r = compare(spark, n, qs[n], sqls[n], sf_dir, con)
        bad += not (r["hash_match"] and r["cols_match"] and r["rows"][0] == r["rows"][1])
        print(r, flush=True)
    print("MISMATCHES", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
