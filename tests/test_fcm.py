"""FCM passes and plans against brute force, plus properties and edge
cases (SURVEY section 5)."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from conftest import SF_SMALL
from fuzzmill.functions import kernels
from fuzzmill.operators.features import to_points
from fuzzmill.operators.passes import fuzzy_pass
from fuzzmill.plans.fcm import fcm, fcm_chunked, resolve_init, seed_centers
from fuzzmill.plans.kmeans import assign, kmeans
from fuzzmill.plans.two_level import merge_fcm, partial_fcm, polish, two_level_fcm

CX = ["c_acctbal", "c_nationkey"]


def _cust(spark):
    return spark.read.parquet(f"{SF_SMALL}/customer.parquet")


def _local_points(df, cols, order):
    rows = df.orderBy(order).select(*cols).collect()
    return [[float(r[c]) for c in cols] for r in rows]


def test_pass_engines_match_brute(spark):
    df = _cust(spark)
    pts = to_points(df, CX)
    X = _local_points(df, CX, "c_custkey")
    V = np.array(X[:3])
    new, wts, _ = brute.fcm_pass(X, [1.0] * len(X), V.tolist(), 2.0)
    for eng in ("expr", "arrow"):
        r = fuzzy_pass(pts, V, 2.0, eng)
        assert np.allclose(r.weights, wts, rtol=1e-10)
        assert np.allclose(r.sums / r.weights[:, None], new, rtol=1e-10)
        assert r.count == len(X)


def test_fcm_matches_brute_with_eps(spark):
    df = _cust(spark)
    X = _local_points(df, CX, "c_custkey")
    res = fcm(df, CX, 3, 2.0, 1e-3, 50, "first", order_col="c_custkey")
    V, W, passes = brute.fcm(X, [1.0] * len(X), X[:3], 2.0, 1e-3, 50)
    assert res.passes == passes
    assert np.allclose(res.centers, V, rtol=1e-9)
    assert np.allclose(res.weights, W, rtol=1e-9)


def test_weight_two_equals_row_twice(spark):
    """T7: every row twice equals weight 2."""
    df = _cust(spark)
    V = resolve_init(df, CX, 3, "first", order_col="c_custkey")
    twice = df.unionByName(df)
    a = fuzzy_pass(to_points(twice, CX), V, 2.0)
    b = fuzzy_pass(to_points(df.withColumn("w2", F.lit(2.0)), CX, weight="w2"), V, 2.0)
    assert np.allclose(a.sums, b.sums, rtol=1e-10)
    assert np.allclose(a.weights, b.weights, rtol=1e-10)


def test_one_centre_is_weighted_mean(spark):
    df = _cust(spark)
    r = fcm(df, CX, 1, 2.0, -1.0, 1, "first", order_col="c_custkey")
    mean = df.agg(*[F.avg(c) for c in CX]).first()
    assert np.allclose(r.centers[0], list(mean), rtol=1e-10)


def test_point_equal_to_centre_and_duplicate_centres():
    """T3: the guard makes a point on a centre finite; equal centres stay equal."""
    X = np.array([[1.0, 2.0], [1.0, 2.0], [5.0, 5.0]])
    V = np.array([[1.0, 2.0], [1.0, 2.0]])
    sums, w = kernels.fuzzy_sums(X, None, V, 2.0)
    assert np.all(np.isfinite(sums)) and np.all(np.isfinite(w))
    assert np.allclose(sums[0], sums[1]) and w[0] == w[1]


def test_edge_errors(spark):
    """T5: n < C, NaN, m = 1, empty table."""
    df = _cust(spark).limit(2)
    with pytest.raises(ValueError):
        fcm(df, CX, 3, 2.0, 1e-3, 5, "first", order_col="c_custkey")
    with pytest.raises(ValueError):
        fcm(_cust(spark), CX, 3, 1.0, 1e-3, 5, "first", order_col="c_custkey")
    nan = _cust(spark).withColumn("c_acctbal", F.when(F.col("c_custkey") == 7, F.lit(float("nan"))).otherwise(F.col("c_acctbal")))
    with pytest.raises(ValueError):
        fcm(nan, CX, 3, 2.0, 1e-3, 5, "first", order_col="c_custkey")
    empty = _cust(spark).where(F.col("c_custkey") < 0)
    with pytest.raises(ValueError):
        fcm(empty, CX, 3, 2.0, 1e-3, 5, [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]])


def test_max_iter_zero_runs_one_pass(spark):
    r = fcm(_cust(spark), CX, 3, 2.0, 1e-3, 0, "first", order_col="c_custkey")
    assert r.passes == 1


def test_chunk_fold_matches_brute_local_and_distributed(spark):
    df = _cust(spark)
    X = _local_points(df, CX, "c_custkey")
    rows = math.ceil(len(X) / 3)
    V, W = brute.fold(X, X[:3], rows, 2.0, -1.0, 2)
    for mode in ("local", "distributed"):
        r = fcm_chunked(df, CX, 3, rows, "c_custkey", 2.0, -1.0, 2, "first", mode=mode)
        assert np.allclose(r.centers, V, rtol=1e-9), mode
        assert np.allclose(r.weights, W, rtol=1e-9), mode


def test_one_chunk_equals_whole_table(spark):
    df = _cust(spark)
    n = df.count()
    a = fcm_chunked(df, CX, 3, n, "c_custkey", 2.0, -1.0, 3, "first")
    b = fcm(df, CX, 3, 2.0, -1.0, 3, "first", order_col="c_custkey")
    assert np.allclose(a.centers, b.centers, rtol=1e-9)
    assert np.allclose(a.weights, b.weights, rtol=1e-9)


def test_partial_keyed_matches_brute_and_merge(spark):
    df = _cust(spark)
    V0 = resolve_init(df, CX, 3, "first", order_col="c_custkey")
    parts = partial_fcm(df, CX, V0, 2.0, -1.0, 2, block_col="c_nationkey").collect()
    rows = df.select("c_nationkey", *CX).collect()
    for b in {r["c_nationkey"] for r in rows}:
        pts = [[float(r[c]) for c in CX] for r in rows if r["c_nationkey"] == b]
        V, W, _ = brute.fcm(pts, [1.0] * len(pts), V0.tolist(), 2.0, -1.0, 2)
        got = sorted([r for r in parts if r["block"] == b], key=lambda r: r["c"])
        assert np.allclose([g["features"] for g in got], V, rtol=1e-9)
        assert [g["w"] for g in got] == [math.floor(w + 0.5) for w in W]
    pt = [list(r["features"]) for r in parts if r["w"] != 0]
    pw = [r["w"] for r in parts if r["w"] != 0]
    Vm, Wm, _ = brute.fcm(pt, pw, V0.tolist(), 2.0, -1.0, 3)
    pdf = spark.createDataFrame(parts)
    for mode in ("local", "distributed"):
        mg = merge_fcm(pdf, V0, 2.0, -1.0, 3, mode=mode)
        assert np.allclose(mg.centers, Vm, rtol=1e-9), mode
    pol = polish(spark, mg.centers, mg.weights, 2.0, -1.0, 2)
    Vp, _, _ = brute.fcm(mg.centers.tolist(), mg.weights.tolist(), mg.centers.tolist(), 2.0, -1.0, 2)
    assert np.allclose(pol.centers, Vp, rtol=1e-9)


def test_hot_key_is_split_into_bounded_blocks(spark):
    """One key holding every row is cut into sub-blocks near block_rows."""
    df = _cust(spark).withColumn("hot", F.lit(1))
    V0 = resolve_init(df, CX, 3, "first", order_col="c_custkey")
    n = df.count()
    parts = partial_fcm(df, CX, V0, 2.0, 1e-3, 20, block_col="hot", block_rows=40).collect()
    sizes = {(r["block"], r["sub"]): r["n"] for r in parts}
    assert {b for b, _ in sizes} == {1}
    assert sum(sizes.values()) == n
    assert max(sizes.values()) <= 2 * 40  # dealt by hash: near block_rows, not exactly
    assert len(sizes) >= math.ceil(n / 40)


def test_partition_blocks_bounded(spark):
    df = _cust(spark)
    V0 = resolve_init(df, CX, 3, "first", order_col="c_custkey")
    parts = partial_fcm(df, CX, V0, 2.0, 1e-3, 20, block_rows=25).collect()
    sizes = {r["block"]: r["n"] for r in parts}
    assert sum(sizes.values()) == df.count()
    assert max(sizes.values()) <= 25


def test_two_level_runs_and_is_close_to_exact(spark):
    df = _cust(spark)
    tl = two_level_fcm(df, CX, 3, 2.0, 1e-4, 100, order_col="c_custkey", sample_rows=60, seed=3)
    ex = fcm(df, CX, 3, 2.0, 1e-4, 100, tl.seeds)
    a = np.sort(tl.centers[:, 0])
    b = np.sort(ex.centers[:, 0])
    assert tl.blocks >= 1
    assert np.allclose(a, b, rtol=0.05, atol=50)


def test_seed_strategies(spark):
    df = _cust(spark)
    for strat in ("whole", "chunked"):
        r = seed_centers(df, CX, 3, strat, sample_rows=30, order_col="c_custkey", seed=1, eps=-1.0, max_iter=2)
        assert r.centers.shape == (3, 2)


def test_kmeans_and_assign_match_brute(spark):
    p = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    PX = ["p_size", "p_retailprice"]
    X = _local_points(p, PX, "p_partkey")
    r = kmeans(p, PX, 3, -1.0, 4, "first", order_col="p_partkey")
    V, cnt = brute.kmeans(X, X[:3], -1.0, 4)
    assert np.allclose(r.centers, V, rtol=1e-9)
    assert list(r.weights) == cnt
    a = assign(p, PX, r.centers, "p_partkey").orderBy("id").collect()
    for row, x in zip(a, X):
        d = [sum((u - v) ** 2 for u, v in zip(x, c)) for c in r.centers]
        assert row["c"] == d.index(min(d))
        assert math.isclose(row["distance"], math.sqrt(min(d)), rel_tol=1e-9)


def test_kmeans_arrow_engine_matches_expr(spark):
    from fuzzmill.operators.features import Points
    from fuzzmill.plans.kmeans import kmeans_pass

    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    pts = to_points(e, "embedding", 64)
    V = resolve_init(e, "embedding", 5, "first", order_col="vec_id", dims=64)
    s1, c1 = kmeans_pass(Points(pts.df, 64, False), V, "expr")
    s2, c2 = kmeans_pass(Points(pts.df, 64, False), V, "arrow")
    assert np.allclose(s1, s2) and np.array_equal(c1, c2)


def test_ratio_form_near_one_is_finite_and_matches(spark):
    """Near m = 1 the ratio form stays finite; both engines agree."""
    df = _cust(spark)
    pts = to_points(df, CX)
    V = resolve_init(df, CX, 3, "first", order_col="c_custkey")
    a = fuzzy_pass(pts, V, 1.02, "expr")
    b = fuzzy_pass(pts, V, 1.02, "arrow")
    assert np.all(np.isfinite(a.sums)) and np.allclose(a.sums, b.sums, rtol=1e-9)
    # At m just below the switch the two forms agree with each other.
    X = np.array(_local_points(df, CX, "c_custkey"))
    kernels.RATIO_BELOW_M, keep = 0.0, kernels.RATIO_BELOW_M
    try:
        plain = kernels.fuzzy_sums(X, None, V, 1.5)
    finally:
        kernels.RATIO_BELOW_M = keep
    kernels.RATIO_BELOW_M, keep = 2.0, kernels.RATIO_BELOW_M
    try:
        ratio = kernels.fuzzy_sums(X, None, V, 1.5)
    finally:
        kernels.RATIO_BELOW_M = keep
    assert np.allclose(plain[0], ratio[0], rtol=1e-9) and np.allclose(plain[1], ratio[1], rtol=1e-9)


def test_pass_ignores_row_order_and_partitioning(spark):
    df = _cust(spark)
    V = resolve_init(df, CX, 3, "first", order_col="c_custkey")
    a = fuzzy_pass(to_points(df, CX), V, 2.0)
    shuffled = df.repartition(7, "c_nationkey").orderBy(F.desc("c_acctbal"))
    for eng in ("expr", "arrow"):
        b = fuzzy_pass(to_points(shuffled, CX), V, 2.0, eng)
        assert np.allclose(a.sums, b.sums, rtol=1e-12)
        assert np.allclose(a.weights, b.weights, rtol=1e-12)


def test_run_job_from_text(spark, scratch):
    """Text points in, merged (with weights) and final centres out."""
    from fuzzmill.plans.job import run_job
    from fuzzmill.sources.points import read_centers, read_weighted_centers

    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    line = F.concat_ws(";", *[F.col(c).cast("string") for c in ["l_quantity", "l_discount", "l_tax"]])
    li.select(line.alias("value")).write.text(f"{scratch}/in")
    res = run_job(spark, f"{scratch}/in", f"{scratch}/out", 3, 3, 1e-3, 2.0, ";", 300, 50, block_rows=2000)
    merged = read_weighted_centers(spark, f"{scratch}/out/merged", 3).orderBy("c").collect()
    final = read_centers(spark, f"{scratch}/out/final").orderBy("c").collect()
    assert len(merged) == 3 and len(final) == 3
    assert np.allclose([r["features"] for r in final], res.centers)
    assert np.allclose([r["w"] for r in merged], res.merged_weights)
    assert res.blocks >= 3


def test_size_check_fallbacks(spark, monkeypatch):
    """Beyond each broadcast bound the plan shuffles instead; same result."""
    from fuzzmill.operators import indexing
    from fuzzmill.plans import two_level

    df = _cust(spark)
    # A key holding a third of all rows next to ordinary keys.
    n = df.count()
    keyed = df.withColumn(
        "blk", F.when(F.col("c_custkey") < n // 3, F.lit(99)).otherwise(F.col("c_nationkey"))
    )
    V0 = resolve_init(df, CX, 3, "first", order_col="c_custkey")
    a = partial_fcm(keyed, CX, V0, 2.0, -1.0, 2, block_col="blk", block_rows=20).collect()
    monkeypatch.setattr(two_level, "BROADCAST_MAX_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else Spark broadcasts by itself
    b = partial_fcm(keyed, CX, V0, 2.0, -1.0, 2, block_col="blk", block_rows=20).collect()
    assert sum(r["n"] for r in a if r["c"] == 0) == n == sum(r["n"] for r in b if r["c"] == 0)
    assert max(r["n"] for r in b) <= 40
    ra = sorted((r["block"], r["sub"], r["c"], tuple(np.round(r["features"], 6))) for r in a)
    rb = sorted((r["block"], r["sub"], r["c"], tuple(np.round(r["features"], 6))) for r in b)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ra == rb
    # The row index with and without the offset broadcast.
    i1 = [r["__idx"] for r in indexing.with_row_index(df.select("c_custkey"), "c_custkey").orderBy("c_custkey").collect()]
    monkeypatch.setattr(indexing, "BROADCAST_MAX_PARTS", 0)
    i2 = [r["__idx"] for r in indexing.with_row_index(df.select("c_custkey"), "c_custkey", 5).orderBy("c_custkey").collect()]
    assert i1 == i2 == list(range(n))


def test_row_index_spreads_a_hot_order_key(spark):
    """A third of the rows share one order-key value: still dense 0..n-1 and
    no range partition holds them all."""
    from fuzzmill.operators.indexing import with_row_index

    df = _cust(spark)
    n = df.count()
    hot = df.withColumn("k", F.when(F.col("c_custkey") < n // 3, F.lit(-1)).otherwise(F.col("c_custkey")))
    idx = with_row_index(hot.select("k", "c_custkey"), "k", 6)
    got = idx.orderBy("__idx").collect()
    assert [r["__idx"] for r in got] == list(range(n))
    ks = [r["k"] for r in got]
    assert ks == sorted(ks)
    per_part = idx.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_part) < n // 3


def test_row_index_slices_are_runs_of_positions(spark):
    """A slice is an interval of tags that the parquet scan filters on."""
    from fuzzmill.operators.indexing import row_index

    n = 1000
    idx = row_index(spark.range(n).select((F.col("id") * 7 % n).alias("k")), "k", 5)
    assert idx.n == n and len(idx.starts) > 1
    edges = [0, 1, idx.starts[1] - 1, idx.starts[1], idx.starts[1] + 1, n - 1, n, n + 5]
    for lo in edges:
        for hi in edges:
            assert sorted(r["k"] for r in idx.slice(lo, hi).collect()) == list(range(n))[lo:hi]
    plan = idx.slice(10, 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(__mid" in plan and "LessThanOrEqual(__mid" in plan
    empty = row_index(spark.range(0), "id", 3)
    assert empty.n == 0 and empty.slice(0, 5).collect() == [] and empty.numbered().collect() == []


def test_partial_keyed_string_and_null_keys(spark):
    """String keys get a hashed block id; a big null-key group is split too."""
    df = _cust(spark)
    n = df.count()
    V0 = resolve_init(df, CX, 3, "first", order_col="c_custkey")
    s = partial_fcm(df, CX, V0, 2.0, -1.0, 2, block_col="c_mktsegment").collect()
    assert len({r["block"] for r in s}) == df.select("c_mktsegment").distinct().count()
    assert sum(r["n"] for r in s if r["c"] == 0) == n
    nul = df.withColumn("k", F.when(F.col("c_custkey") < n // 2, F.lit(None).cast("int")).otherwise(F.col("c_nationkey")))
    p = partial_fcm(nul, CX, V0, 2.0, -1.0, 2, block_col="k", block_rows=30).collect()
    assert sum(r["n"] for r in p if r["c"] == 0) == n
    assert max(r["n"] for r in p) <= 60


def test_command_line_job_and_sweep(spark, scratch):
    from fuzzmill.__main__ import main
    from fuzzmill.sources.points import read_centers

    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    li.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ["l_quantity", "l_discount"]]).alias("value")).write.text(f"{scratch}/in")
    main(["job", f"{scratch}/in", f"{scratch}/out", "3", "2", "0.001", "2.0", " ", "200", "30"])
    assert read_centers(spark, f"{scratch}/out/final").count() == 3
    spark.createDataFrame([("2",)], "value string").write.text(f"{scratch}/ks")
    spark.createDataFrame([("0.5",)], "value string").write.text(f"{scratch}/eps")
    main(["sweep", f"{scratch}/in", f"{scratch}/grid", "2", "2", "0.5", "2.0", " ", "100", "3",
          "1", "300", "1", f"{scratch}/eps", f"{scratch}/ks"])
    assert spark.read.parquet(f"{scratch}/grid").count() == 6


def test_zero_weight_partials_change_nothing(spark):
    """A block whose weights round to 0 drops out of the merge."""
    df = _cust(spark)
    V0 = resolve_init(df, CX, 3, "first", order_col="c_custkey")
    parts = partial_fcm(df, CX, V0, 2.0, -1.0, 2, block_col="c_nationkey").collect()
    pdf = spark.createDataFrame(parts)
    zero = spark.createDataFrame(
        [(10_000 + i, 0, i, [1e6 * (i + 1), -5.0], 0.0, 1, 1) for i in range(3)], pdf.schema
    )
    for mode in ("local", "distributed"):
        a = merge_fcm(pdf, V0, 2.0, -1.0, 3, mode=mode)
        b = merge_fcm(pdf.unionByName(zero), V0, 2.0, -1.0, 3, mode=mode)
        assert np.allclose(a.centers, b.centers, rtol=1e-12)


def test_history_records_every_shift(spark):
    r = fcm(_cust(spark), CX, 3, 2.0, 1e-3, 30, "first", order_col="c_custkey")
    assert len(r.history) == r.passes and r.history[-1] == r.shift


def test_seeds_skip_incomplete_rows(spark):
    df = _cust(spark).withColumn(
        "c_acctbal", F.when(F.col("c_custkey") == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal"))
    )
    V = resolve_init(df, CX, 3, "first", order_col="c_custkey")
    first = df.where(F.col("c_custkey").isin(1, 2, 3)).orderBy("c_custkey").select(*CX).collect()
    assert np.allclose(V, [[r[0], r[1]] for r in first])
    r = fcm(df, CX, 3, 2.0, -1.0, 2, "first", order_col="c_custkey")
    assert r.n == df.count() - 1


def test_arrow_cells_direct_and_reduced_agree(spark, monkeypatch):
    from fuzzmill.operators import passes

    df = _cust(spark)
    pts = to_points(df, CX)
    V = resolve_init(df, CX, 3, "first", order_col="c_custkey")
    a = fuzzy_pass(pts, V, 2.0, "arrow")
    monkeypatch.setattr(passes, "DIRECT_MAX_ROWS", 0)
    b = fuzzy_pass(pts, V, 2.0, "arrow")
    assert np.allclose(a.sums, b.sums, rtol=1e-12) and a.count == b.count


def test_local_fold_needs_k_rows(spark):
    df = _cust(spark).limit(2)
    with pytest.raises(ValueError):
        fcm_chunked(df, CX, 3, 3, "c_custkey", 2.0, -1.0, 2, "first", mode="local")


def test_assign_engines_agree_on_wide_points(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    V = resolve_init(e, "embedding", 10, "first", order_col="vec_id", dims=64)
    a = {r["id"]: (r["c"], r["distance"]) for r in assign(e, "embedding", V, "vec_id", 64, "expr").collect()}
    b = {r["id"]: (r["c"], r["distance"]) for r in assign(e, "embedding", V, "vec_id", 64, "arrow").collect()}
    assert a.keys() == b.keys()
    assert all(a[k][0] == b[k][0] and math.isclose(a[k][1], b[k][1], rel_tol=1e-9) for k in a)


def test_uncached_passes_match_cached(spark):
    df = _cust(spark)
    a = fcm(df, CX, 3, 2.0, -1.0, 3, "first", order_col="c_custkey")
    b = fcm(df, CX, 3, 2.0, -1.0, 3, "first", order_col="c_custkey", cache=False)
    assert np.allclose(a.centers, b.centers, rtol=1e-12) and a.n == b.n


def test_hot_string_and_null_keys_split_without_overflow(spark):
    """A hot string key (hashed id) and a hot null key both split."""
    df = _cust(spark)
    n = df.count()
    V0 = resolve_init(df, CX, 3, "first", order_col="c_custkey")
    k = df.withColumn("s", F.when(F.col("c_custkey") < n // 2, F.lit("hot")).otherwise(F.lit(None)))
    p = partial_fcm(k, CX, V0, 2.0, -1.0, 2, block_col="s", block_rows=30).collect()
    assert sum(r["n"] for r in p if r["c"] == 0) == n
    assert max(r["n"] for r in p) <= 60
    assert any(r["block"] is None for r in p) and len({r["block"] for r in p}) == 2


def test_two_level_counts_points_and_blocks(spark):
    df = _cust(spark)
    tl = two_level_fcm(df, CX, 3, 2.0, 1e-3, 20, order_col="c_custkey", sample_rows=60,
                       seed=3, block_rows=200)
    assert tl.n == df.count()
    assert tl.blocks >= math.ceil(df.count() / 200)
