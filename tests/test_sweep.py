"""The shared-scan sweep against runs made one by one."""

from __future__ import annotations

import numpy as np
import pytest

from fuzzmill.plans.sweep import sweep

X = ["x", "y"]
GRID = dict(ks=[2, 3, 4], epsilons=[5.0, 0.5, 1e-3], k=3, eps=0.05, samples=2, sample_rows=400, repeats=2, max_iter=30, seed=5)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(c, 4, (250, 2)) for c in ((0, 0), (60, 10), (20, 80))])
    rows = [(i % 600, float(a), float(b)) for i, (a, b) in enumerate(xy)]  # some ids repeat
    return spark.createDataFrame(rows, "id INT, x DOUBLE, y DOUBLE").repartition(3)


def by_run(out):
    return {(r.algo, r.varied, r.sample, r.repeat, r.k, r.eps): r for r in out.collect()}


def test_shared_passes_equal_single_runs(spark, points, scratch):
    grid = {**GRID, "samples": 1, "max_iter": 8}
    shared = by_run(sweep(points, X, id_col="id", path=f"{scratch}/out", **grid))
    alone = by_run(sweep(points, X, id_col="id", shared=False, **{**grid, "ks": [2], "epsilons": [5.0], "repeats": 1}))
    assert len(shared) == 3 * 2 * (3 + 3) and len(alone) == 3 * 2
    for run, r in alone.items():
        s = shared[run]
        assert s.passes == r.passes and len(s.centers) == r.k
        assert s.shift == pytest.approx(r.shift, abs=1e-9)
        assert np.allclose(s.centers, r.centers, atol=1e-8) and np.allclose(s.weights, r.weights, atol=1e-8)


def test_epsilons_leave_one_trajectory_at_their_own_pass(points):
    got = by_run(sweep(points, X, id_col="id", algos=("kmeans", "fuzzy_kmeans"), **{**GRID, "samples": 1}))
    for algo in ("kmeans", "fuzzy_kmeans"):
        for u in range(2):
            runs = [got[algo, "epsilon", 0, u, 3, e] for e in (5.0, 0.5, 1e-3)]
            assert runs[0].passes <= runs[1].passes <= runs[2].passes
            assert all(r.shift <= r.eps or r.passes == 30 for r in runs)
    assert got["fuzzy_kmeans", "epsilon", 0, 0, 3, 5.0].passes < got["fuzzy_kmeans", "epsilon", 0, 0, 3, 1e-3].passes


def test_a_grid_takes_the_passes_of_its_slowest_run(spark, points):
    sc = spark.sparkContext
    sc.setJobGroup("grid", "grid")
    try:
        got = by_run(sweep(points, X, id_col="id", **{**GRID, "samples": 1}))
        jobs = len(sc.statusTracker().getJobIdsForGroup("grid"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    slowest = max(r.passes for (a, *_), r in got.items() if a != "two_level_fcm")
    together = sum(r.passes for r in got.values())
    assert slowest < 31 and together > 5 * slowest
    assert jobs <= slowest + 30, (jobs, slowest, together)


def test_grid_errors(points):
    with pytest.raises(ValueError, match="unknown algo"):
        sweep(points, X, id_col="id", algos=("other",), **GRID)
    with pytest.raises(ValueError, match="initial centres"):
        sweep(points, X, id_col="id", **{**GRID, "sample_rows": 3})
