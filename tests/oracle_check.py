"""Compare registered Spark queries with their DuckDB oracles.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: name, rows, match.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        if v != v:
            return "nan"
        return round(v, 4) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: repr(t)
    )


def compare(spark, sf_dir, name, qfn, sql, con):
    t0 = time.time()
    sdf = qfn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, rows=len(srows), match=None, sec=round(t1 - t0, 2))
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    ok = sorted(scols) == sorted(dcols) and rows_of(scols, srows) == rows_of(dcols, drows)
    out = dict(name=name, rows=len(srows), orows=len(drows), match=ok, sec=round(t1 - t0, 2))
    if not ok:
        out["spark_cols"] = scols
        out["duck_cols"] = dcols
        out["spark_head"] = rows_of(scols, srows)[:3]
        out["duck_head"] = rows_of(dcols, drows)[:3]
    return out


def main():
    import __spark_entry__ as entry
    from fuzzmill.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    if os.environ.get("DEFAULT_SESSION"):
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session()
    con = duck(sf_dir)
    qs = entry.queries()
    os_ = entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, sf_dir, name, fn, os_.get(name), con)
        except Exception as e:  # noqa: BLE001
            r = dict(name=name, error=f"{type(e).__name__}: {str(e)[:300]}")
        if r.get("match") is False or "error" in r:
            bad += 1
        print(r, flush=True)
    print(f"bad={bad}")


if __name__ == "__main__":
    main()
