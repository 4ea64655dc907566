"""Growth check: lineitem features amplified by Spark (x1, x4, x16, each
copy shifted slightly so no row repeats), written as many-file parquet,
then two-level FCM and fixed-pass exact FCM on each size.

Usage: python tools/scale_run.py [sf_dir] [factors...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from fuzzmill.plans.fcm import fcm, resolve_init  # noqa: E402
from fuzzmill.plans.two_level import two_level_fcm  # noqa: E402
from fuzzmill.session import local_session, scratch_path  # noqa: E402

X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    factors = [int(a) for a in sys.argv[2:]] or [1, 4, 16]
    spark = local_session()
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", *X)
    out = {}
    for f in factors:
        big = li.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(f - 1)))).select(
            (F.col("l_orderkey") * f + F.col("copy")).alias("l_orderkey"),
            "l_linenumber",
            *[(F.col(c) * (1 + F.col("copy") * 1e-6)).alias(c) for c in X],
        )
        path = scratch_path(spark, f"scale-x{f}")
        big.repartition(8 * f).write.parquet(path)
        df = spark.read.parquet(path)
        n = df.count()
        seeds = resolve_init(df, X, 3, "first", order_col=["l_orderkey", "l_linenumber"])
        t0 = time.perf_counter()
        tl = two_level_fcm(df, X, 3, 2.0, 5e-4, 100, order_col=["l_orderkey", "l_linenumber"],
                           sample_rows=3000, seed=1)
        t1 = time.perf_counter()
        ex = fcm(df, X, 3, 2.0, -1.0, 10, seeds)
        t2 = time.perf_counter()
        out[f"x{f}"] = {
            "rows": n, "partitions": df.rdd.getNumPartitions(),
            "two_level_sec": round(t1 - t0, 2), "two_level_stages": tl.stage_sec,
            "blocks": tl.blocks, "fcm_10_passes_sec": round(t2 - t1, 2),
        }
        print(json.dumps({f"x{f}": out[f"x{f}"]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
