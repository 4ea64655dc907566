"""Run with task retries enabled and a failure injected into the first
attempt of one partition of every stage that reads the input: results must
equal a run without failures.  Prints OK on success.

Usage: python tests/retry_check.py SF_DIR
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import numpy as np  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from fuzzmill.operators.indexing import with_row_index  # noqa: E402
from fuzzmill.plans.fcm import fcm  # noqa: E402
from fuzzmill.plans.two_level import partial_fcm, two_level_fcm  # noqa: E402

CX = ["c_acctbal", "c_nationkey"]


MARKS = tempfile.mkdtemp(prefix="fuzzmill-retry-marks-")


def flaky(batches, marks=MARKS):
    import uuid

    ctx = TaskContext.get()
    if ctx.attemptNumber() == 0 and ctx.partitionId() == 1:
        open(os.path.join(marks, uuid.uuid4().hex), "w").close()
        raise RuntimeError("injected task failure")
    yield from batches


def main():
    sf = sys.argv[1]
    spark = (
        SparkSession.builder.master("local[4,3]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fuzzmill-retry-"))
    base = spark.read.parquet(f"{sf}/customer.parquet").repartition(4, "c_custkey")
    bad = base.mapInArrow(flaky, base.schema)

    a = fcm(base, CX, 3, 2.0, -1.0, 3, "first", order_col="c_custkey")
    b = fcm(bad, CX, 3, 2.0, -1.0, 3, "first", order_col="c_custkey")
    assert np.allclose(a.centers, b.centers, rtol=1e-12), "fcm"

    kw = dict(order_col="c_custkey", sample_rows=60, seed=2, block_rows=100)
    a = two_level_fcm(base, CX, 3, 2.0, -1.0, 3, **kw)
    b = two_level_fcm(bad, CX, 3, 2.0, -1.0, 3, **kw)
    assert np.allclose(a.centers, b.centers, rtol=1e-9), "two_level"

    V0 = a.seeds
    pa_ = partial_fcm(base.withColumn("hot", F.lit(1)), CX, V0, 2.0, -1.0, 3, block_col="hot", block_rows=40)
    pb_ = partial_fcm(bad.withColumn("hot", F.lit(1)), CX, V0, 2.0, -1.0, 3, block_col="hot", block_rows=40)
    ra = sorted((r["block"], r["sub"], r["c"], round(r["w"], 6)) + tuple(np.round(r["features"], 6)) for r in pa_.collect())
    rb = sorted((r["block"], r["sub"], r["c"], round(r["w"], 6)) + tuple(np.round(r["features"], 6)) for r in pb_.collect())
    assert ra == rb, "keyed partial with a split hot key"

    ia = with_row_index(base.select("c_custkey"), "c_custkey").orderBy("__idx").collect()
    ib = with_row_index(bad.select("c_custkey"), "c_custkey").orderBy("__idx").collect()
    assert [tuple(r) for r in ia] == [tuple(r) for r in ib], "row index"
    failures = len(os.listdir(MARKS))
    assert failures > 0, "no failure was injected"
    print(f"OK {failures} failed attempts retried")
    spark.stop()


if __name__ == "__main__":
    main()
