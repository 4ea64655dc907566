"""Parameter sweep (IT-13): samples x centre counts x repeats, then
samples x epsilons x repeats, three algorithms each.

Samples are drawn once per sample index (LM-3, seeded), persisted, and
shared by all runs on that sample.  The runs of a sample share their passes
too: one Arrow pass over the sample carries the sums of every run that is
still moving, so a grid takes as many passes as its slowest run.  Runs that
differ only in epsilon go the same way and stop at different passes: they
are one trajectory, from which each epsilon reads its result.  The seeds of
all repeats and centre counts come from one scan (the seeds for k centres
are the first k of those for more), and the two-level runs share one job
each for seeding, blocks and merge.

Every run adds one result row ``(algo, varied, sample, repeat, k, eps,
passes, shift, ms, centers, weights)``.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..operators import sampling
from ..operators.features import Points, spread, to_points, xname
from ..operators.passes import LONG_SCHEMA, check_m, collect_cells, long_partials, splits
from .fcm import FCMResult, drop_incomplete, first_distinct
from .kmeans import fuzzy_kmeans, kmeans
from .two_level import MERGE_LOCAL_MAX_CELLS, NO_WEIGHT, default_block_rows, polish, two_level_fcm, weighted_fcm

ALGOS = ("kmeans", "fuzzy_kmeans", "two_level_fcm")


def _grid(values, kind):
    if isinstance(values, DataFrame):
        return [kind(r[0]) for r in values.select(values.columns[0]).collect()]
    return [kind(v) for v in values]


def write_sweep(results: DataFrame, path: str) -> None:
    """SNK-5: append results, one folder per varied parameter."""
    results.write.mode("append").partitionBy("varied").parquet(path)


def sweep_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField("algo", T.StringType(), False),
            T.StructField("varied", T.StringType(), False),
            T.StructField("sample", T.IntegerType(), False),
            T.StructField("repeat", T.IntegerType(), False),
            T.StructField("k", T.IntegerType(), False),
            T.StructField("eps", T.DoubleType(), False),
            T.StructField("passes", T.IntegerType(), False),
            T.StructField("shift", T.DoubleType(), True),
            T.StructField("ms", T.LongType(), False),
            T.StructField("centers", T.ArrayType(T.ArrayType(T.DoubleType())), False),
            T.StructField("weights", T.ArrayType(T.DoubleType()), False),
        ]
    )


# ---- trajectories: full-table passes of many runs at once ---------------------


@dataclass
class Trajectory:
    """One way of centres from given seeds, and where each epsilon leaves it."""

    algo: str
    centers: np.ndarray
    epsilons: list[float]
    max_iter: int
    m: float = 2.0
    passes: int = 0
    ms: float = 0.0
    found: dict = field(default_factory=dict)  # eps -> FCMResult, with its ms

    @property
    def cells(self) -> int:
        return self.centers.size + len(self.centers)

    @property
    def live(self) -> bool:
        return len(self.found) < len(self.epsilons)

    def sums(self, X: np.ndarray, XT: np.ndarray) -> np.ndarray:
        if self.algo == "kmeans":
            s, w = kernels.kmeans_sums(X, self.centers)
        else:
            s, w = kernels.fuzzy_sums_t(XT, None, self.centers, self.m)
        return np.concatenate([s.ravel(), w])

    def step(self, cells: np.ndarray, n: int, ms: float) -> None:
        """Take the sums of a pass."""
        if n == 0:
            raise ValueError("the point table is empty")
        if not np.isfinite(cells).all():
            raise ValueError("a pass produced NaN: the points contain NaN or infinite values")
        V = self.centers
        sums, weights = cells[: V.size].reshape(V.shape), cells[V.size :]
        new = kernels.update(sums, weights, V)
        moved = np.sqrt(((new - V) ** 2).sum(axis=1)).max() if self.algo == "kmeans" else kernels.shift(V, new)
        self.centers, self.passes, self.ms = new, self.passes + 1, self.ms + ms
        for eps in self.epsilons:
            if eps not in self.found and (moved <= eps or self.passes >= self.max_iter):
                self.found[eps] = (FCMResult(new, weights, self.passes, float(moved), n), int(self.ms))


def shared_passes(points: Points, runs: Sequence[Trajectory], finished=None) -> None:
    """Move all ``runs`` to where their last epsilon stops them: each job is
    one pass over ``points`` for every run that still moves.  ``finished``
    is called after each pass."""
    D = points.dims
    while live := [r for r in runs if r.live]:
        began = time.perf_counter()

        def run(batches, live=live):
            total, n = np.zeros(sum(r.cells for r in live)), 0
            for b in batches:
                if b.num_rows == 0:
                    continue
                XT = np.vstack([b.column(xname(j)).to_numpy(zero_copy_only=False) for j in range(D)]).astype(float, copy=False)
                X = np.ascontiguousarray(XT.T)
                total += np.concatenate([r.sums(X, XT) for r in live])
                n += b.num_rows
            yield long_partials(np.append(total, n))

        size = sum(r.cells for r in live) + 1
        cells = collect_cells(points.df.select(*points.xs).mapInArrow(run, LONG_SCHEMA), size, splits(points))
        ms, at = (time.perf_counter() - began) * 1000, 0
        for r in live:
            end = at + r.cells
            r.step(cells[at:end], int(cells[-1]), ms)
            at = end
        if finished:
            finished()


# ---- two-level runs of a grid at once -----------------------------------------

_ROWS = "run INT, c INT, features ARRAY<DOUBLE>, w DOUBLE, passes INT, shift DOUBLE"


def _rows(run: int, V, W, passes: int, moved: float) -> dict:
    k = len(V)
    return {
        "run": [run] * k, "c": list(range(k)), "features": [list(map(float, r)) for r in V],
        "w": [float(x) for x in W], "passes": [passes] * k, "shift": [float(moved)] * k,
    }


def _table(parts: list[dict]) -> pa.RecordBatch:
    kinds = dict(run=pa.int32(), c=pa.int32(), features=pa.list_(pa.float64()), w=pa.float64(), passes=pa.int32(), shift=pa.float64())
    return pa.RecordBatch.from_pydict({c: pa.array([v for p in parts for v in p[c]], t) for c, t in kinds.items()})


def _by_run(rows) -> dict[int, tuple]:
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["run"], r["c"])):
        out.setdefault(r["run"], []).append(r)
    return {
        run: (np.array([r["features"] for r in got]), np.array([r["w"] for r in got]), got[0]["passes"], got[0]["shift"])
        for run, got in out.items()
    }


def two_level_runs(
    points: Points, seeding: DataFrame, seed_rows: int, runs: Sequence[tuple], m: float, max_iter: int
) -> dict[int, FCMResult]:
    """Two-level FCM for every run ``(repeat, k, eps)`` of a grid in three
    jobs.  ``seeding`` holds the seeding rows of each repeat: ``rep``, the
    order ``key`` and the coordinates (a bounded sample, of which a run uses
    the first ``seed_rows``, or k)."""
    m = check_m(m)
    D = points.dims
    xs = [xname(j) for j in range(D)]
    runs = list(runs)

    def matrix(t) -> np.ndarray:
        return np.column_stack([t.column(x).to_numpy(zero_copy_only=False) for x in xs]).astype(float, copy=False)

    def seed(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("key", "ascending"), *((x, "ascending") for x in xs)]))
        X, rep, parts = matrix(table), table.column("rep")[0].as_py(), []
        for i, (r, k, eps) in enumerate(runs):
            if r == rep and len(X) >= k:
                part = X[: max(k, seed_rows)]
                parts.append(_rows(i, *kernels.local_fcm(part, None, first_distinct(part, k), m, eps, max_iter)))
        return pa.Table.from_batches([_table(parts)])

    seeds = _by_run(seeding.groupBy("rep").applyInArrow(seed, _ROWS).collect())
    for i, (_, k, _) in enumerate(runs):
        if i not in seeds:
            raise ValueError(f"need {k} initial centres: the sample has fewer complete rows")
    block_rows = default_block_rows(D)

    def blocks(batches):
        held, size = [], 0

        def solve():
            X, parts = np.vstack(held), []
            for i, (_, _, eps) in enumerate(runs):
                V, W, passes, moved = kernels.local_fcm(X, None, seeds[i][0], m, eps, max_iter)
                parts.append(_rows(i, V, np.floor(W + 0.5), passes, moved))
            return _table(parts)

        for b in batches:
            if b.num_rows:
                held.append(matrix(b))
                size += b.num_rows
            if size >= block_rows:
                yield solve()
                held, size = [], 0
        if size:
            yield solve()

    partials = points.df.select(*points.xs).mapInArrow(blocks, _ROWS).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        most = partials.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("passes").alias("passes")).collect()
        passes = {r["run"]: r["passes"] for r in most}

        def merge(table: pa.Table) -> pa.Table:
            i = table.column("run")[0].as_py()
            X = np.array(table.column("features").to_pylist(), float)
            w = table.column("w").to_numpy().astype(float)
            got = kernels.local_fcm(X, w, seeds[i][0], m, runs[i][2], max_iter)
            return pa.Table.from_batches([_table([_rows(i, *got)])])

        weighted = partials.where(F.col("w") != 0)
        if max(r["n"] for r in most) * D <= MERGE_LOCAL_MAX_CELLS:
            merged = _by_run(weighted.groupBy("run").applyInArrow(merge, _ROWS).collect())
        else:
            merged = {}
            for i, (_, k, eps) in enumerate(runs):
                r = weighted_fcm(weighted.where(F.col("run") == i).select("features", "w"), k, m, eps, max_iter, seeds[i][0])
                merged[i] = (r.centers, r.weights, r.passes, r.shift)
    finally:
        partials.unpersist()
    out = {}
    for i, (_, _, eps) in enumerate(runs):
        if i not in merged:
            raise ValueError(NO_WEIGHT)
        V, W, merge_passes, _ = merged[i]
        r = polish(points.df.sparkSession, V, W, m, eps, max_iter)
        out[i] = FCMResult(r.centers, r.weights, passes[i] + merge_passes + r.passes, r.shift)
    return out


# ---- the sweep ------------------------------------------------------------------


def _alone(algo, sample, features, k, eps, seed, *, id_col, m, max_iter, sample_rows, dims) -> FCMResult:
    """One run by itself, as a timing of its own needs it."""
    if algo == "kmeans":
        return kmeans(sample, features, k, eps, max_iter, "random", id_col=id_col, seed=seed, dims=dims)
    if algo == "fuzzy_kmeans":
        return fuzzy_kmeans(sample, features, k, eps, max_iter, id_col=id_col, seed=seed, dims=dims)
    return two_level_fcm(sample, features, k, m, eps, max_iter, order_col=id_col, sample_rows=max(k, sample_rows), seed=seed, dims=dims)


def sweep(
    df: DataFrame,
    features,
    *,
    id_col: str | Sequence[str],
    ks: Sequence[int],
    epsilons: Sequence[float],
    k: int,
    eps: float,
    samples: int = 1,
    sample_rows: int = 10_000,
    repeats: int = 1,
    m: float = 2.0,
    max_iter: int = 20,
    algos: Sequence[str] = ALGOS,
    seed=0,
    dims: int | None = None,
    seed_rows: int | None = None,
    path: str | None = None,
    shared: bool = True,
) -> DataFrame:
    """IT-13: returns the result table.  ``ks`` and ``epsilons`` are lists
    or one-column grid tables (SRC-4, ``read_grid``); a grid is a handful of
    values.  ``seed_rows`` bounds the rows that seed the two-level form
    (default: the whole sample).  With ``path`` rows are appended there as
    runs end (SNK-5), so a run that fails loses no other; the result is read
    back from it.

    ``ms`` is the time of the jobs that a run took part in.  They serve the
    other runs too; ``shared=False`` runs every run alone, for timings of
    single runs, with the same results."""
    spark = df.sparkSession
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    ks, epsilons = _grid(ks, int), _grid(epsilons, float)
    unknown = set(algos) - set(ALGOS)
    if unknown:
        raise ValueError(f"unknown algo {sorted(unknown)[0]!r}")
    grid = [("centers", kk, float(eps), u) for kk in ks for u in range(repeats)]
    grid += [("epsilon", int(k), ee, u) for ee in epsilons for u in range(repeats)]
    rows: list[tuple] = []

    def add(s: int, done: list[tuple]) -> None:
        """Rows of runs that ended: (algo, varied, repeat, k, eps, result, ms)."""
        new = [
            (
                a, varied, s, u, int(kk), float(ee), int(r.passes), None if r.shift != r.shift else float(r.shift), int(ms),
                [[float(x) for x in v] for v in r.centers], [float(w) for w in r.weights],
            )
            for a, varied, u, kk, ee, r, ms in done
        ]
        rows.extend(new)
        if path and new:
            write_sweep(spark.createDataFrame(new, sweep_schema()).coalesce(1), path)

    for s in range(samples):
        sample = sampling.sample_k(df, sample_rows, f"{seed}.{s}", ids).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if shared:
                _shared(sample, features, ids, dims, grid, algos, f"{seed}.{s}", m, max_iter, seed_rows or sample_rows, lambda done, s=s: add(s, done))
                continue
            for varied, kk, ee, u in grid:
                for a in algos:
                    began = time.perf_counter()
                    r = _alone(
                        a, sample, features, kk, ee, f"{seed}.{s}.{u}", id_col=ids, m=m, max_iter=max_iter,
                        sample_rows=seed_rows or sample_rows, dims=dims,
                    )
                    add(s, [(a, varied, u, kk, ee, r, (time.perf_counter() - began) * 1000)])
        finally:
            sample.unpersist()
    if path:
        return spark.read.schema(sweep_schema()).parquet(path)
    return spark.createDataFrame(rows, sweep_schema())


def _shared(sample, features, ids, dims, grid, algos, seed, m, max_iter, seed_rows, add) -> None:
    """All runs on one sample."""
    most, repeats = max(kk for _, kk, _, _ in grid), 1 + max(u for *_, u in grid)
    keyed = drop_incomplete(to_points(sample, features, dims, keep=ids))
    D = keyed.dims
    heads = sampling.sample_k_repeated(keyed.df, max(most, seed_rows), repeats, seed, ids, keep_key="key")
    heads = heads.select("rep", "key", *keyed.xs).persist(StorageLevel.MEMORY_AND_DISK)
    points = Points(spread(keyed.df.select(*keyed.xs)), D, False)
    points.df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        trajectories: dict[tuple, Trajectory] = {}
        if {"kmeans", "fuzzy_kmeans"} & set(algos):
            first = heads.orderBy("key", *(xname(j) for j in range(D)))
            start = {u: [] for u in range(repeats)}
            for u in range(repeats):
                top = first.where(F.col("rep") == u).limit(most) if repeats > 1 else first.limit(most)
                start[u] = np.array([[r[xname(j)] for j in range(D)] for r in top.collect()], float).reshape(-1, D)
            for _, kk, ee, u in grid:
                if len(start[u]) < kk:
                    raise ValueError(f"need {kk} initial centres, got {len(start[u])}")
                for a in ("kmeans", "fuzzy_kmeans"):
                    if a in algos:
                        t = trajectories.setdefault((a, kk, u), Trajectory(a, start[u][:kk], [], max_iter))
                        if ee not in t.epsilons:
                            t.epsilons.append(ee)
            written: set = set()

            def finished() -> None:
                done = []
                for i, (varied, kk, ee, u) in enumerate(grid):
                    for a in algos:
                        t = trajectories.get((a, kk, u))
                        if t and ee in t.found and (i, a) not in written:
                            written.add((i, a))
                            done.append((a, varied, u, kk, ee, *t.found[ee]))
                add(done)

            shared_passes(points, list(trajectories.values()), finished)
        if "two_level_fcm" in algos:
            began = time.perf_counter()
            runs = sorted({(u, kk, ee) for _, kk, ee, u in grid})
            # one block per split of the sample, as it lies
            found = two_level_runs(Points(keyed.df.select(*keyed.xs), D, False), heads, seed_rows, runs, m, max_iter)
            ms = (time.perf_counter() - began) * 1000
            add([("two_level_fcm", varied, u, kk, ee, found[runs.index((u, kk, ee))], ms) for varied, kk, ee, u in grid])
    finally:
        heads.unpersist()
        points.df.unpersist()
