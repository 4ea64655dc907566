"""Baselines: hard k-means (IT-9), nearest-centre assignment (IT-10),
fuzzy k-means (IT-11) and the cluster report (IT-12).

Semantics we fix (the reference only calls library drivers here):
unguarded squared Euclidean distance; nearest centre with ties to the
lowest ``c``; a new centre is the mean of its points; an empty centre
stays; stop when every centre moves by a Euclidean distance <= eps, or
after ``max_iter`` passes.  ``pyspark.ml.clustering.KMeans`` cannot start
from given seeds, hence our own step.

Each k-means pass is one job: distances projected once over literal
centres, nearest index by ``least``, then one global aggregate of
conditional sums per centre (partial aggregation in every task, one row
per task to the final aggregate); wide points use numpy over Arrow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.fcm_math import sq_distance_sql
from ..operators.features import Points, spread, to_points, xname
from ..operators.passes import EXPR_MAX_CELLS, LONG_SCHEMA, collect_cells, long_partials, splits
from ..session import loop_frame
from .fcm import FCMResult, drop_incomplete, fcm, resolve_init


def _pick(ds: list[Column]) -> tuple[Column, Column]:
    best = F.least(*ds) if len(ds) > 1 else ds[0]
    idx = None
    for i in range(len(ds) - 1, -1, -1):
        idx = F.lit(i) if idx is None else F.when(ds[i] == best, F.lit(i)).otherwise(idx)
    return idx.cast("int"), best


def with_distances(pts: Points, V: np.ndarray, keep=()) -> tuple[DataFrame, list[Column]]:
    """Project each squared distance once (built as SQL text, one call per
    column), so the nearest-centre choice refers to columns instead of
    repeating C x D-term expressions."""
    xs = [xname(j) for j in range(pts.dims)]
    ds = [f"{sq_distance_sql(xs, V[i])} AS __d{i}" for i in range(V.shape[0])]
    df = pts.df.selectExpr(*keep, *xs, *ds)
    return df, [F.col(f"__d{i}") for i in range(V.shape[0])]


def kmeans_pass(pts: Points, V: np.ndarray, engine: str = "auto"):
    C, D = V.shape
    if engine == "auto":
        engine = "expr" if V.size <= EXPR_MAX_CELLS else "arrow"
    if engine == "arrow":
        Vc = np.array(V, dtype=float)

        def run(batches):
            sums = np.zeros((C, D))
            counts = np.zeros(C)
            for rb in batches:
                if rb.num_rows == 0:
                    continue
                X = np.column_stack(
                    [rb.column(xname(j)).to_numpy(zero_copy_only=False) for j in range(D)]
                ).astype(float, copy=False)
                s, c = kernels.kmeans_sums(X, Vc)
                sums += s
                counts += c
            yield long_partials(np.concatenate([sums.ravel(), counts]))

        cells = collect_cells(pts.df.select(*pts.xs).mapInArrow(run, LONG_SCHEMA), C * D + C, splits(pts))
        return cells[: C * D].reshape(C, D), cells[C * D :]
    # One global aggregate of C x (D + 1) conditional sums: partial
    # aggregation in every task, one small row per task to a single reducer.
    df, ds = with_distances(pts, V)
    idx, _ = _pick(ds)
    assigned = df.select(idx.alias("__c"), *pts.xs)
    aggs = []
    for i in range(C):
        aggs += [f"SUM(IF(__c = {i}, {xname(j)}, 0.0D)) AS s{i}_{j}" for j in range(D)]
        aggs.append(f"COUNT_IF(__c = {i}) AS n{i}")
    row = assigned.selectExpr(*aggs).collect()[0]
    sums = np.array([[row[f"s{i}_{j}"] or 0.0 for j in range(D)] for i in range(C)], dtype=float)
    counts = np.array([row[f"n{i}"] or 0 for i in range(C)], dtype=float)
    return sums, counts


def kmeans(
    df: DataFrame,
    features,
    k: int,
    eps: float = 1e-3,
    max_iter: int = 20,
    init="random",
    *,
    id_col=None,
    order_col=None,
    seed=0,
    dims: int | None = None,
    cache: bool = True,
    mode: str = "distributed",
) -> FCMResult:
    """IT-9: hard k-means from given (or LM-5 random) seeds.  ``weights``
    of the result are the cluster sizes of the last pass.  ``cache=False``
    re-reads the pruned table every pass instead of keeping it.
    ``mode='local'`` runs all passes inside one task, for a table known to
    be small (as a sample is)."""
    V = resolve_init(df, features, k, init, order_col=order_col, id_col=id_col, seed=seed, dims=dims)
    pts = drop_incomplete(to_points(df, features, V.shape[1]))
    if mode == "local":
        return _kmeans_local(pts, V, eps, max_iter)
    if mode != "distributed":
        raise ValueError(f"unknown mode {mode!r}")
    if cache:
        pts = Points(spread(pts.df), pts.dims, False)
        pts.df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with loop_frame(pts.df) as rows:
            return _kmeans_loop(Points(rows, pts.dims, False), V, eps, max_iter)
    finally:
        if cache:
            pts.df.unpersist()


def _kmeans_local(pts: Points, V: np.ndarray, eps: float, max_iter: int) -> FCMResult:
    """The loop inside one task."""
    D = pts.dims

    def run(table: pa.Table) -> pa.Table:
        X = np.column_stack([table.column(xname(j)).to_numpy() for j in range(D)]).astype(float, copy=False)
        r = _kmeans_steps(lambda C_: kernels.kmeans_sums(X, C_), V, eps, max_iter)
        k = len(r.centers)
        return pa.table(
            {
                "c": pa.array(range(k), pa.int32()), "features": pa.array(r.centers.tolist(), pa.list_(pa.float64())),
                "w": pa.array(r.weights, pa.float64()), "passes": pa.array([r.passes] * k, pa.int32()),
                "shift": pa.array([r.shift] * k, pa.float64()),
            }
        )

    rows = pts.df.select(F.lit(0).alias("__g"), *pts.xs).groupBy("__g")
    got = rows.applyInArrow(run, "c INT, features ARRAY<DOUBLE>, w DOUBLE, passes INT, shift DOUBLE").collect()
    if not got:
        return _kmeans_steps(lambda C_: (np.zeros(C_.shape), np.zeros(len(C_))), V, eps, max_iter)
    got.sort(key=lambda r: r["c"])
    centers, counts = np.array([r["features"] for r in got]), np.array([r["w"] for r in got])
    return FCMResult(centers, counts, got[0]["passes"], got[0]["shift"], int(counts.sum()))


def _kmeans_loop(pts: Points, V: np.ndarray, eps: float, max_iter: int) -> FCMResult:
    return _kmeans_steps(lambda C_: kmeans_pass(pts, C_), V, eps, max_iter)


def _kmeans_steps(step, V: np.ndarray, eps: float, max_iter: int) -> FCMResult:
    passes = 0
    while True:
        sums, counts = step(V)
        if np.isnan(sums).any() or np.isinf(sums).any():
            raise ValueError("a pass produced NaN: the points contain NaN or infinite values")
        new = V.copy()
        ok = counts > 0
        new[ok] = sums[ok] / counts[ok, None]
        moved = float(np.sqrt(((new - V) ** 2).sum(axis=1)).max())
        V = new
        passes += 1
        if moved <= eps or passes >= max_iter:
            return FCMResult(V, counts, passes, moved, int(counts.sum()))


def assign(
    df: DataFrame, features, centers, id_col: str, dims: int | None = None, engine: str = "auto"
) -> DataFrame:
    """IT-10: ``(id, c, distance)`` - each point's nearest centre (ties to
    the lowest index) and its Euclidean distance.  Row-wise: no shuffle.
    Wide points (C x D above the crossover) use numpy over Arrow batches."""
    V = np.asarray(centers, dtype=float)
    C, D = V.shape
    pts = drop_incomplete(to_points(df, features, dims or D, keep=[id_col]))
    if engine == "auto":
        engine = "expr" if V.size <= EXPR_MAX_CELLS else "arrow"
    if engine == "expr":
        dfd, ds = with_distances(pts, V, keep=[id_col])
        idx, best = _pick(ds)
        return dfd.select(F.col(id_col).alias("id"), idx.alias("c"), F.sqrt(best).alias("distance"))
    id_type = pts.df.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("c", T.IntegerType(), False),
            T.StructField("distance", T.DoubleType(), False),
        ]
    )

    def run(batches):
        for rb in batches:
            X = np.column_stack(
                [rb.column(xname(j)).to_numpy(zero_copy_only=False) for j in range(D)]
            ).astype(float, copy=False)
            c, d2 = kernels.nearest(X, V)
            yield pa.RecordBatch.from_arrays(
                [rb.column(id_col), pa.array(c.astype(np.int32)), pa.array(np.sqrt(d2))],
                names=["id", "c", "distance"],
            )

    return pts.df.select(id_col, *pts.xs).mapInArrow(run, schema)


def fuzzy_kmeans(
    df: DataFrame, features, k: int, eps: float = 1e-3, max_iter: int = 20, *,
    id_col, seed=0, dims=None, cache: bool = True,
) -> FCMResult:
    """IT-11: fuzzy k-means baseline = FCM with m = 2 from LM-5 seeds, every
    pass over the whole table; points are not assigned."""
    return fcm(df, features, k, 2.0, eps, max_iter, "random", id_col=id_col, seed=seed, dims=dims, cache=cache)


def describe_clusters(centers: DataFrame) -> DataFrame:
    """IT-12: one row per centre: c, coordinates, weight, width."""
    return centers.select("c", "features", "w", F.size("features").alias("dims"))
