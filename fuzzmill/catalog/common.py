"""Shared pieces of the registered queries: table access, the fixed query
parameters, output shaping, and the registration decorator."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracle_sql as osql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle=None):
    """Register a Spark query (and optionally its SQL generator)."""

    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- fixed parameters of the registered queries ------------------------------

M = 2.0
PASSES = 3  # fixed passes (eps < 0) so SQL can replay the loop
FEW = 2  # passes per inner loop for the nested plans
NO_EPS = -1.0

CUST_X = ["c_acctbal", "c_nationkey"]
PART_X = ["p_size", "p_retailprice"]
LINE_X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def round4(*names: str):
    return [F.round(F.col(n), 4).alias(n) for n in names]


def matrix_out(spark: SparkSession, V, W=None, w_name: str = "w", w_type: str = "DOUBLE") -> DataFrame:
    """c INT, x0 .. x{D-1}, [w] rounded to 4 decimals, from a small
    centre matrix (C rows) brought back by a Spark job."""
    V = np.asarray(V, dtype=float)
    D = V.shape[1]
    rows = []
    for i in range(V.shape[0]):
        row = [i] + [float(v) for v in V[i]]
        if W is not None:
            row.append(float(W[i]) if w_type == "DOUBLE" else int(W[i]))
        rows.append(tuple(row))
    schema = "c INT, " + ", ".join(f"x{j} DOUBLE" for j in range(D))
    if W is not None:
        schema += f", {w_name} {w_type}"
    df = spark.createDataFrame(rows, schema)
    cols = [F.col("c")] + round4(*[f"x{j}" for j in range(D)])
    if W is not None:
        cols += round4(w_name) if w_type == "DOUBLE" else [F.col(w_name)]
    return df.select(*cols)


def centers_table_out(df: DataFrame, dims: int, with_w: bool = True) -> DataFrame:
    """A centre table (c, features, w) flattened and rounded."""
    cols = [F.col("c").cast("int").alias("c")] + [
        F.round(F.col("features")[j], 4).alias(f"x{j}") for j in range(dims)
    ]
    if with_w:
        cols.append(F.round(F.col("w"), 4).alias("w"))
    return df.select(*cols)


# ---- SQL helpers ----------------------------------------------------------------


def pts_sql(tbl: str, cols: Sequence[str], extra: str = "", where: str = "") -> str:
    xs = ", ".join(f"CAST({c} AS DOUBLE) AS x{j}" for j, c in enumerate(cols))
    w = f" WHERE {where}" if where else ""
    return f"SELECT {xs}{extra} FROM {tbl}{w}"


def xs_of(d: int) -> list[str]:
    return [f"x{j}" for j in range(d)]


def seeded_pts(q: osql.Sql, tbl: str, cols, k: int, order: str, extra: str = ""):
    """Point CTE + one-row seed CTE (first k rows by ``order``)."""
    pts = q.add(pts_sql(tbl, cols, extra), "pts")
    seed = osql.seed_first(q, pts, xs_of(len(cols)), k, order)
    return pts, seed


def sample_key_sql(id_text: str, others: Sequence[str], seed) -> str:
    """The key by which LM-3 draws a row: md5 of id and seed, and where
    several rows share the id, of that, the other columns and the ordinal
    among equal rows."""
    base = f"md5({id_text} || '-{seed}')"
    parts = "".join(f", {c}" for c in others)
    ordinal = f"CAST(row_number() OVER (PARTITION BY {id_text}{parts}) - 1 AS VARCHAR)"
    texts = "".join(f"coalesce(CAST({c} AS VARCHAR), '\\N'), " for c in others)
    return (
        f"CASE WHEN count(*) OVER (PARTITION BY {id_text}) = 1 THEN {base} "
        f"ELSE md5({base} || '-' || concat_ws('|', {texts}{ordinal})) END"
    )
