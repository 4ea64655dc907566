"""Plan-level checks of the scale properties (captured explain output)."""

from __future__ import annotations

import contextlib
import io

import numpy as np

from conftest import SF_SMALL
from fuzzmill.operators import sampling
from fuzzmill.operators.features import to_points
from fuzzmill.operators.passes import sums_expr
from fuzzmill.plans.fcm import drop_incomplete
from fuzzmill.plans.two_level import partial_fcm

LX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
V = np.array([[10, 10000, 0.02, 0.01], [30, 40000, 0.05, 0.04]], float)


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_pass_reads_only_features_with_pushed_filters(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    p = plan(sums_expr(drop_incomplete(to_points(li, LX)), V, 2.0))
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_tax:double>" in p
    assert "IsNotNull(l_extendedprice)" in p
    assert "Exchange SinglePartition" in p and "partial_sum" in p
    assert "Join" not in p and "Generate" not in p


def test_partial_stage_does_not_shuffle_split_input(spark, scratch):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    par = spark.sparkContext.defaultParallelism
    li.repartition(par * 2).write.parquet(f"{scratch}/li")
    many = spark.read.parquet(f"{scratch}/li")
    assert many.rdd.getNumPartitions() >= par
    p = plan(partial_fcm(many, LX, V, 2.0, 1e-3, 10))
    assert "MapInArrow" in p
    assert "Exchange" not in p


def test_sample_is_a_top_k(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    p = plan(sampling.sample_k(o, 10, 1, "o_orderkey").select("o_orderkey", "o_totalprice"))
    assert "TakeOrderedAndProject" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p
    assert "Exchange" not in p
