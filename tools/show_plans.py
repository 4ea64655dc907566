"""Print the physical plans of the headline operators (formatted explain).

Usage: python tools/show_plans.py [sf_dir] > PLANS.txt
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from fuzzmill.operators import sampling  # noqa: E402
from fuzzmill.operators.features import to_points  # noqa: E402
from fuzzmill.operators.indexing import row_index  # noqa: E402
from fuzzmill.operators.passes import sums_arrow, sums_expr  # noqa: E402
from fuzzmill.plans.fcm import drop_incomplete, resolve_init  # noqa: E402
from fuzzmill.plans.kmeans import assign  # noqa: E402
from fuzzmill.plans.two_level import partial_fcm  # noqa: E402
from fuzzmill.session import local_session  # noqa: E402


def show(title, df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    print(f"==== {title} ====")
    print(buf.getvalue())


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    V = np.array([[10, 10000, 0.02, 0.01], [30, 40000, 0.05, 0.04], [45, 80000, 0.08, 0.07]], float)
    pts = drop_incomplete(to_points(li, X))
    show("AG-1 one FCM pass, expression engine", sums_expr(pts, V, 2.0))
    show("AG-1 one FCM pass, Arrow engine (long partial cells)", sums_arrow(pts, V, 2.0))
    show("IT-4 partial FCM per block (mapInArrow, no shuffle of points)",
         partial_fcm(li, X, V, 2.0, 1e-3, 50))
    c = spark.read.parquet(f"{sf}/customer.parquet")
    Vc = resolve_init(c, ["c_acctbal", "c_nationkey"], 3, "first", order_col="c_custkey")
    show("IT-4 partial FCM keyed by c_nationkey (applyInArrow)",
         partial_fcm(c, ["c_acctbal", "c_nationkey"], Vc, 2.0, 1e-3, 50, block_col="c_nationkey"))
    o = spark.read.parquet(f"{sf}/orders.parquet")
    show("LM-3 fixed-size sample (top-k on a seeded md5 key)",
         sampling.sample_k(o, 200, 42, "o_orderkey").select("o_orderkey", "o_totalprice"))
    show("LM-1 coin-flip sample",
         sampling.coin_flip_sample(o, 500, "o_orderkey", 7).select("o_orderkey", "o_totalprice"))
    idx = row_index(c.select("c_custkey", "c_acctbal", "c_nationkey"), "c_custkey")
    show("IT-3 one chunk of the row-indexed table (range filter pushed to parquet)",
         idx.slice(375, 750))
    from fuzzmill.plans.kmeans import _pick, with_distances

    pp = drop_incomplete(to_points(li, X))
    dfd, ds = with_distances(pp, V)
    idx, _ = _pick(ds)
    aggs = [f"SUM(IF(__c = {i}, __x{j}, 0.0D)) AS s{i}_{j}" for i in range(3) for j in range(4)]
    aggs += [f"COUNT_IF(__c = {i}) AS n{i}" for i in range(3)]
    show("IT-9 one k-means pass (global conditional sums)", dfd.select(idx.alias("__c"), *pp.xs).selectExpr(*aggs))
    p = spark.read.parquet(f"{sf}/part.parquet")
    show("IT-10 nearest-centre assignment", assign(p, ["p_size", "p_retailprice"],
                                                   [[10, 900], [30, 1500], [45, 1900]], "p_partkey"))
    spark.stop()


if __name__ == "__main__":
    main()
