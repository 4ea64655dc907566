"""Answers that must not depend on size switches, layout or null keys."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import fuzzmill.operators.sampling as sampling
import fuzzmill.plans.two_level as two_level
from fuzzmill.operators.features import to_points, wrong_width
from fuzzmill.operators.passes import fuzzy_pass
from fuzzmill.plans.fcm import drop_incomplete, fcm, fcm_chunked, resolve_init, seed_centers
from fuzzmill.plans.job import run_job
from fuzzmill.plans.kmeans import kmeans, kmeans_pass
from fuzzmill.plans.two_level import merge_fcm, partial_fcm, two_level_fcm
from fuzzmill.sources.points import count_lines, parse_lines, read_centers, read_weighted_centers

X = ["x", "y"]


@pytest.fixture(scope="module")
def odd_keys(spark):
    """600 points; a third without a key, keys that tie."""
    rng = np.random.default_rng(7)
    rows = [(None if k % 3 == 0 else k // 4, float(a), float(b)) for k, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    return spark.createDataFrame(rows, "id BIGINT, x DOUBLE, y DOUBLE")


def picked(df):
    return sorted((r["x"], r["y"]) for r in df.collect())


def test_samples_do_not_depend_on_the_size_switch(odd_keys, monkeypatch):
    flip = picked(sampling.coin_flip_sample(odd_keys, 30, ["id", "x", "y"], 3))
    hashed = picked(sampling.sample_k(odd_keys, 30, 3, "id", X))
    monkeypatch.setattr(sampling, "TOPK_STREAM_MAX_ROWS", 0)
    assert picked(sampling.coin_flip_sample(odd_keys, 30, ["id", "x", "y"], 3)) == flip
    assert picked(sampling.sample_k(odd_keys, 30, 3, "id", X)) == hashed


def test_null_keys_are_sampled_like_others(spark):
    """A third of the rows without a key: about a third of every sample."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("id"), F.col("id").cast("double").alias("x"))
    for seed in range(5):
        got = sampling.sample_k(df, 600, seed, "id", ["x"]).collect()
        assert len({r["x"] for r in got}) == 600
        assert 140 <= sum(r["id"] is None for r in got) <= 260


@pytest.fixture(scope="module")
def hot_point(spark):
    """90,000 points, a third of them one point; other points stand up to
    four times."""
    rows = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 25_000).alias("p"))
    return rows.select(F.array(F.col("p").cast("double"), (F.col("p") * 2).cast("double")).alias("features")).repartition(7)


def hot_share(df):
    return sum(r["features"][0] == -1 for r in df.collect())


def test_a_point_is_drawn_as_often_as_it_stands(hot_point, monkeypatch):
    plain = {}
    for seed in range(6):
        got = sampling.sample_k(hot_point, 3000, seed, "features")
        assert got.count() == 3000
        plain[seed] = sorted(r["features"] for r in got.collect())
        assert 900 <= hot_share(got) <= 1100
    # the same sample by every way there is
    monkeypatch.setattr(sampling, "TOPK_STREAM_MAX_ROWS", 0)
    monkeypatch.setattr(sampling, "COPY_BLOCK", 1000)
    monkeypatch.setattr(sampling, "BROADCAST_MAX_IDS", 3)
    for seed in (0, 3):
        got = sampling.sample_k(hot_point.repartition(3), 3000, seed, "features")
        assert sorted(r["features"] for r in got.collect()) == plain[seed]


def test_copies_are_drawn_without_replacement(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(1, "b")] * 2 + [(2, "a")], "id INT, v STRING")
    got = sampling.sample_k(df, 100, 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    drawn = [(r["id"], r["v"]) for r in sampling.sample_k_repeated(df, 1, 60).collect()]
    assert len(drawn) == 60
    assert {(1, "a"), (1, "b"), (2, "a")} == set(drawn) and drawn.count((1, "a")) > drawn.count((2, "a"))
    keyed = sampling.keyed_rows(df, ["id"], [1, 2])
    keys = [k for r in keyed.collect() for k in r[sampling.KEY]]
    assert len(set(keys)) == 16


def test_seeds_and_job_seeds_see_a_repeated_point(hot_point):
    """A third of the mass at one point: a centre lies on it whatever the seed."""
    for seed in range(3):
        centers = seed_centers(hot_point, "features", 3, "whole", sample_rows=600, order_col="features", seed=seed, dims=2, max_iter=60).centers
        assert np.abs(centers - np.array([-1.0, -2.0])).sum(axis=1).min() < 3000
        assert len(np.unique(centers.round(6), axis=0)) == 3


def test_uniform_seeds_see_the_whole_table(spark):
    df = spark.range(20_000).select("id", F.col("id").cast("double").alias("x"))
    centers = seed_centers(df, ["x"], 2, "whole", sample_rows=300, order_col="id").centers
    assert centers.max() > 10_000
    prefix = seed_centers(df, ["x"], 2, "whole", sample_rows=300, order_col="id", sample="prefix").centers
    assert prefix.max() < 1_000


def test_fold_forms_agree_on_ties_and_null_keys(odd_keys):
    a = fcm_chunked(odd_keys, X, 3, 150, "id", 2.0, -1.0, 3, mode="local")
    for parts in (1, 7):
        b = fcm_chunked(odd_keys.repartition(parts), X, 3, 150, "id", 2.0, -1.0, 3, mode="distributed")
        assert np.allclose(a.centers, b.centers, atol=1e-9) and np.allclose(a.weights, b.weights)


def test_arrays_of_another_width_are_dropped_not_cut(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0, 500.0],), ([5.0],), (None,), ([7.0, 8.0],)], "v ARRAY<DOUBLE>")
    pts = drop_incomplete(to_points(df, "v", 2))
    assert sorted(tuple(r) for r in pts.df.collect()) == [(1.0, 2.0), (7.0, 8.0)]
    assert wrong_width(df, "v", 2) == 3
    with pytest.raises(ValueError, match="widths"):
        to_points(df, "v")


def test_too_many_given_seeds_raise(odd_keys):
    with pytest.raises(ValueError, match="need 3"):
        resolve_init(odd_keys, X, 3, np.zeros((5, 2)))
    with pytest.raises(ValueError, match="need 3"):
        fcm(odd_keys, X, 3, 2.0, -1.0, 1, np.zeros((2, 2)))


def test_all_zero_weights_fail_alike(odd_keys):
    V = np.array([[0.0, 0.0], [1.0, 1.0]])
    parts = partial_fcm(odd_keys, X, V, 2.0, -1.0, 1).withColumn("w", F.lit(0.0))
    for mode in ("local", "distributed"):
        with pytest.raises(ValueError, match="zero"):
            merge_fcm(parts, V, 2.0, -1.0, 1, mode=mode)


def test_rounding_can_be_turned_off_and_loss_is_reported(spark):
    df = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    seeds = np.array([[float(k), 10.0 * k] for k in range(5)])
    kept = two_level_fcm(df, X, 5, 2.0, -1.0, 2, seeds=seeds, block_col="id", round_weights=False)
    assert kept.lost_points == 0 and kept.n == 60
    with pytest.raises(ValueError, match="zero"):
        two_level_fcm(df, X, 5, 2.0, -1.0, 1, seeds=seeds + 1000.0, block_col="id")
    coarse = two_level_fcm(df.withColumn("b", F.when(F.col("id") < 50, F.lit(1)).otherwise(F.col("id")).cast("bigint")), X, 5, 2.0, -1.0, 2, seeds=seeds, block_col="b")
    # ten blocks of one point: nine spread it over five centres and round it away, one point lies on a centre
    assert coarse.lost_points == 9 and coarse.n == 60 and coarse.passes == 6 and coarse.polish_passes == 2


def test_hash_blocks_do_not_follow_the_layout(odd_keys):
    seeds = np.array([[0.0, 0.0], [1.0, 1.0], [-1.0, 0.5]])
    runs = [two_level_fcm(odd_keys.repartition(p), X, 3, 2.0, -1.0, 3, seeds=seeds, blocks=6) for p in (4, 16)]
    assert np.allclose(runs[0].centers, runs[1].centers, atol=1e-9) and runs[0].blocks == runs[1].blocks


def test_hot_key_join_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.range(900).select(F.when(F.col("id") < 600, F.lit(1)).otherwise(F.col("id") % 5).cast("bigint").alias("k"), F.col("id").cast("double").alias("x"))
    V = np.array([[10.0], [500.0]])
    total = lambda: sorted((r["block"], r["n"]) for r in partial_fcm(df, ["x"], V, 2.0, -1.0, 1, block_col="k", block_rows=50).where("c = 0").groupBy("block").agg(F.sum("n").alias("n")).collect())
    want = total()
    monkeypatch.setattr(two_level, "BROADCAST_MAX_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert total() == want == sorted((r["k"], r["count"]) for r in df.groupBy("k").count().collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("engine", ["expr", "arrow"])
def test_kmeans_refuses_nan(spark, engine):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, float("nan"), 1.0), (3, 3.0, 3.0)], "id INT, x DOUBLE, y DOUBLE")
    V = np.array([[0.0, 0.0], [3.0, 3.0]])
    with pytest.raises(ValueError, match="NaN"):
        kmeans(df, X, 2, -1.0, 1, V)
    sums, _ = kmeans_pass(to_points(df.where("id <> 2"), X), V, engine)
    assert np.allclose(sums, [[1, 2], [3, 3]])


def test_kmeans_without_cache_is_equal(odd_keys):
    V = np.array([[0.0, 0.0], [1.0, 1.0]])
    a, b = (kmeans(odd_keys, X, 2, -1.0, 4, V, cache=c) for c in (True, False))
    assert np.allclose(a.centers, b.centers)
    c = kmeans(odd_keys, X, 2, -1.0, 4, V, mode="local")
    assert np.allclose(a.centers, c.centers) and np.allclose(a.weights, c.weights) and c.passes == a.passes == 4 and c.n == a.n


def test_text_lines_are_split_once(spark, scratch):
    spark.createDataFrame([("1 2 3 4",), ("5 6 7 8  ",), ("9 9",), ("a b c d",)], "value STRING").write.text(f"{scratch}/t")
    lines = spark.read.text(f"{scratch}/t")
    pts = drop_incomplete(to_points(parse_lines(lines, " ", 4, strict=False), "features", 4))
    plan = pts.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert pts.df.count() == 2
    assert count_lines(lines, " ", 4) == {"points": 2, "wrong_width": 1, "not_numbers": 1}
    with pytest.raises(Exception, match="not a number"):
        parse_lines(lines, " ", 4).collect()


def test_weighted_lines_with_trailing_blanks(spark, scratch):
    spark.createDataFrame([("0\t1.0 2.0 7.0 ",), ("1.5 2.5 8.0\t ",), ("1.0 2.0",)], "value STRING").coalesce(1).write.text(f"{scratch}/w")
    got = [(r["features"], r["w"]) for r in read_weighted_centers(spark, f"{scratch}/w", 2).orderBy("c").collect()]
    assert got == [([1.0, 2.0], 7.0), ([1.5, 2.5], 8.0)]


def test_center_lines_follow_file_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 1\n2 2\n")
    (tmp_path / "b.txt").write_text("".join(f"{k} {k}\n" for k in range(3, 60)))
    got = [r["features"][0] for r in read_centers(spark, str(tmp_path)).orderBy("c").collect()]
    assert got == [float(k) for k in range(1, 60)]


def test_job_seeds_do_not_depend_on_splits(spark, scratch):
    rng = np.random.default_rng(2)
    rows = [(f"{a:.4f} {b:.4f}",) for a, b in rng.normal(size=(2000, 2)) * 100]
    spark.createDataFrame(rows, "value STRING").repartition(5).write.text(f"{scratch}/p")
    seeds = []
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        res = run_job(spark, f"{scratch}/p", f"{scratch}/o{size}", 3, 2, sample_rows=200, max_iter=5, blocks=4)
        seeds.append((res.seeds, res.centers))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert np.allclose(seeds[0][0], seeds[1][0]) and np.allclose(seeds[0][1], seeds[1][1], atol=1e-6)


def test_engines_sum_memberships_alike(odd_keys):
    """The engine's own passes: each point's squared memberships at m = 2
    add up to the same totals in both, and to numpy's."""
    V = np.array([[0.0, 0.0], [1.0, 1.0], [-1.0, 2.0]])
    pts = to_points(odd_keys, X)
    a, b = (fuzzy_pass(pts, V, 2.0, e) for e in ("expr", "arrow"))
    P = np.array([[r["x"], r["y"]] for r in odd_keys.collect()])
    d = ((P[:, None, :] - V[None]) ** 2).sum(axis=2)
    u = (1 / d) / (1 / d).sum(axis=1, keepdims=True)
    assert np.allclose(u.sum(axis=1), 1)
    assert np.allclose(a.weights, b.weights) and np.allclose(a.weights, (u**2).sum(axis=0), rtol=1e-6)


def test_a_thousand_chunks_fold_in_few_jobs(spark, monkeypatch):
    """Runs of small chunks stream through tasks; the answer is that of the
    fold in one task and of distributed passes per chunk."""
    import fuzzmill.plans.fcm as plans

    rng = np.random.default_rng(11)
    rows = [(int(k // 3), float(a), float(b)) for k, (a, b) in enumerate(rng.normal(size=(4000, 2)) * 10)]
    df = spark.createDataFrame(rows, "id BIGINT, x DOUBLE, y DOUBLE").repartition(5)
    args = (X, 3, 4, "id", 2.0, 1e-3, 20)
    want = fcm_chunked(df, *args, mode="local")
    monkeypatch.setattr(plans, "FOLD_JOB_CELLS", 1600)  # 200 chunks a job
    sc = spark.sparkContext
    sc.setJobGroup("fold", "fold")
    try:
        got = fcm_chunked(df, *args)
        jobs = len(sc.statusTracker().getJobIdsForGroup("fold"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got.passes == want.passes == 1000 and jobs < 20
    assert np.allclose(got.centers, want.centers, atol=1e-9) and np.allclose(got.weights, want.weights)
    monkeypatch.setattr(plans, "CHUNK_LOCAL_CELLS", 0)
    few = (X, 3, 1300, "id", 2.0, 1e-3, 8)
    a, b = fcm_chunked(df, *few), fcm_chunked(df, *few, mode="local")
    assert a.passes == b.passes == 4 and np.allclose(a.centers, b.centers, atol=1e-9)


def test_hot_keys_are_cut_alike_whatever_the_layout(spark, monkeypatch):
    """Text keys (their hashes cannot collide: there are none), a null key,
    a hot key with very many copies of a point; sub-blocks are bounded and
    equal at 4 and 16 partitions, by every join."""
    rng = np.random.default_rng(5)
    rows = [("hot", float(a), float(b)) for a, b in rng.normal(size=(700, 2))] + [("hot", 3.0, 4.0)] * 900
    rows += [(None, float(a), float(b)) for a, b in rng.normal(size=(300, 2))]
    rows += [(f"k{k % 7}", float(a), float(b)) for k, (a, b) in enumerate(rng.normal(size=(90, 2)))]
    df = spark.createDataFrame(rows, "k STRING, x DOUBLE, y DOUBLE")
    V = np.array([[0.0, 0.0], [1.0, 1.0]])

    def run(parts):
        got = partial_fcm(df.repartition(parts), X, V, 2.0, 1e-6, 30, block_col="k", block_rows=100, round_weights=False).collect()
        return {(r["block"], r["sub"], r["c"]): (r["n"], r["w"], *r["features"]) for r in got}

    a, b = run(4), run(16)
    assert set(a) == set(b)
    assert {k for k, *_ in a} == {"hot", None, *(f"k{i}" for i in range(7))}
    assert {s for k, s, _ in a if k == "hot"} == set(range(8)) and {s for k, s, _ in a if k is None} == {0, 1, 2}
    assert sum(v[0] for (k, _, c), v in a.items() if k == "hot" and c == 0) == 1600
    for run_key, v in a.items():
        assert np.allclose(v, b[run_key], atol=1e-8)
    # a key of few points is clustered whole, however often they stand
    few = partial_fcm(df.where("k = 'hot' AND x = 3"), X, V, 2.0, -1.0, 2, block_col="k", block_rows=100, round_weights=False).collect()
    whole = fcm(df.where("x = 3"), X, 2, 2.0, -1.0, 2, V)
    assert {r["sub"] for r in few} == {0} and np.allclose([r["features"] for r in sorted(few, key=lambda r: r["c"])], whole.centers)
    monkeypatch.setattr(two_level, "BROADCAST_MAX_ROWS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = run(4)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(c) == set(a) and all(np.allclose(a[k], c[k], atol=1e-8) for k in a)


def test_line_ids_and_sweep_samples_do_not_depend_on_splits(spark, tmp_path):
    from fuzzmill.plans.sweep import sweep
    from fuzzmill.sources.points import read_points

    rng = np.random.default_rng(8)
    lines = [f"{a:.3f} {b:.3f}" for a, b in rng.normal(size=(1500, 2)) * 50]
    lines[700:900] = ["7.000 7.000"] * 200
    lines[5] = "1 2 3"
    (tmp_path / "p").mkdir()
    for name, part in (("b", lines[600:]), ("a", lines[:600])):
        (tmp_path / "p" / name).write_text("\n".join(part) + "\n")
    seen = []
    for size in ("128m", "3k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        pts = read_points(spark, str(tmp_path / "p"), 2)
        ids = {r["id"]: tuple(r["features"]) for r in pts.collect()}
        assert set(ids) == set(range(1500)) - {5}
        assert all(v == tuple(float(x) for x in lines[i].split()) for i, v in ids.items())
        bare = read_points(spark, str(tmp_path / "p"), 2, with_id=False)
        got = sweep(bare, "features", id_col="features", dims=2, ks=[2], epsilons=[], k=2, eps=0.1, sample_rows=200, max_iter=6, algos=("kmeans",))
        seen.append(got.first()["centers"])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert np.allclose(seen[0], seen[1], atol=1e-9)


@pytest.mark.parametrize("engine", ["expr", "arrow"])
def test_order_free_sums_are_equal_to_the_last_bit(spark, engine):
    """Values over ten orders of magnitude, 40 passes, any partitioning."""
    rng = np.random.default_rng(4)
    rows = [(float(s * 10.0**a), float(b), float(w)) for s, a, b, w in zip(
        rng.choice([-1, 1], 3000), rng.uniform(-4, 6, 3000), rng.normal(size=3000) * 50, rng.integers(1, 9, 3000))]
    df = spark.createDataFrame(rows, "x DOUBLE, y DOUBLE, w DOUBLE")
    V = np.array([[0.0, 0.0], [1e5, 3.0], [-1e5, -7.0]])
    args = dict(engine=engine, cache=False, weight="w")
    runs = [fcm(df.repartition(p), X, 3, 2.0, -1.0, 40, V, order_free=True, **args) for p in (1, 7, 64)]
    for r in runs[1:]:
        assert np.array_equal(r.centers, runs[0].centers) and np.array_equal(r.weights, runs[0].weights)
    plain = fcm(df, X, 3, 2.0, -1.0, 40, V, **args)
    assert np.allclose(plain.centers, runs[0].centers, rtol=1e-6) and np.allclose(plain.weights, runs[0].weights, rtol=1e-6)


def test_a_pass_is_one_job_and_the_session_is_left_alone(spark, odd_keys):
    V = np.array([[0.0, 0.0], [1.0, 1.0]])
    sc, before = spark.sparkContext, dict(spark.conf.getAll)
    for run in (lambda: fcm(odd_keys, X, 2, 2.0, -1.0, 9, V, engine="expr"), lambda: kmeans(odd_keys, X, 2, -1.0, 9, V)):
        sc.setJobGroup("loop", "loop")
        done = len(sc.statusTracker().getJobIdsForGroup("loop"))
        try:
            run()
            jobs = len(sc.statusTracker().getJobIdsForGroup("loop")) - done
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert jobs <= 9 + 2
    assert dict(spark.conf.getAll) == before
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("fuzzmill_")]


def test_polish_of_a_table(spark):
    from fuzzmill.operators.passes import centers_df
    from fuzzmill.plans.two_level import polish, polish_table

    V, w = np.array([[0.0, 1.0], [5.0, 2.0], [9.0, 9.0]]), np.array([3.0, 0.0, 2.0])
    want = polish(spark, V, w, 2.0, 1e-6, 30)
    got = polish_table(centers_df(spark, V, w).repartition(3), 2.0, 1e-6, 30).orderBy("c").collect()
    assert np.allclose([r["features"] for r in got], want.centers) and np.allclose([r["w"] for r in got], want.weights)
