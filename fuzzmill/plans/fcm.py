"""Exact FCM plans: the converge loop (IT-1), FCM of a whole table (IT-2),
the chunk fold (IT-3) and the two seeding strategies (IT-8).

The loop is a driver loop of Spark jobs: each pass is one job that scans
the (cached) point table and returns C x (D + 1) sums; the new centres
(C x D doubles) go back into the next plan as literals, so the plan has
the same size at every pass and lineage never grows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
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
from ..operators.indexing import MID, row_index
from ..operators.passes import (
    PassResult,
    centers_df,
    check_m,
    fuzzy_pass,
    max_shift,
    new_centers,
    order_free_pass,
    term_exponents,
)
from ..session import loop_frame


@dataclass
class FCMResult:
    centers: np.ndarray  # C x D
    weights: np.ndarray  # C, weights of the last pass
    passes: int
    shift: float
    n: int = 0
    history: list = field(default_factory=list)  # shift of every pass

    def to_df(self, spark) -> DataFrame:
        return centers_df(spark, self.centers, self.weights)


def iterate(
    step: Callable[[np.ndarray], PassResult], init, eps: float, max_iter: int
) -> FCMResult:
    """IT-1: do-while converge loop.  One pass at least; stop when the
    largest coordinate move is <= eps or after ``max_iter`` passes."""
    V = np.asarray(init, dtype=float)
    passes = 0
    shifts = []
    while True:
        r = step(V)
        new = new_centers(r, V)
        moved = max_shift(V, new)
        shifts.append(moved)
        V = new
        passes += 1
        if not (moved > eps and passes < max_iter):
            return FCMResult(V, r.weights, passes, moved, r.count, shifts)


# ---- seeds -----------------------------------------------------------------


def _rows_to_matrix(rows, dims: int) -> np.ndarray:
    return np.array([[r[xname(j)] for j in range(dims)] for r in rows], dtype=float)


def resolve_init(
    df: DataFrame,
    features,
    k: int,
    init="first",
    *,
    order_col: str | Sequence[str] | None = None,
    id_col: str | Sequence[str] | None = None,
    seed=0,
    dims: int | None = None,
) -> np.ndarray:
    """Initial centres: 'first' k rows by ``order_col`` (LM-2), 'random' k
    rows by a seeded hash of ``id_col`` (LM-5), an explicit C x D matrix,
    or a centre table with ``features`` (ordered by ``c``)."""
    k = int(k)
    if isinstance(init, DataFrame):
        rows = init.orderBy("c").select("features").collect()
        V = np.array([r["features"] for r in rows], dtype=float)
    elif isinstance(init, str):
        # Seeds are drawn from complete points only (as the passes see them).
        def complete_points(keep):
            keep = [keep] if isinstance(keep, str) else list(keep)
            return drop_incomplete(to_points(df, features, dims, keep=keep))

        if init == "first":
            if order_col is None:
                raise ValueError("init='first' needs order_col")
            pts = complete_points(order_col)
            cols = [order_col] if isinstance(order_col, str) else list(order_col)
            pick = sampling.first_k(pts.df, k, [*cols, *map(xname, range(pts.dims))])
        elif init == "random":
            if id_col is None:
                raise ValueError("init='random' needs id_col")
            pts = complete_points(id_col)
            pick = sampling.random_seeds(pts.df, k, seed, id_col, list(map(xname, range(pts.dims))))
        else:
            raise ValueError(f"unknown init {init!r}")
        V = _rows_to_matrix(pick.select(*pts.xs).collect(), pts.dims)
    else:
        V = np.asarray(init, dtype=float)
    if V.ndim != 2 or V.shape[0] != k:
        raise ValueError(f"need {k} initial centres, got {V.shape[0] if V.ndim == 2 else 0}")
    return V


# ---- IT-2 --------------------------------------------------------------------


def fcm(
    df: DataFrame,
    features,
    k: int,
    m: float = 2.0,
    eps: float = 1e-3,
    max_iter: int = 100,
    init="first",
    *,
    order_col=None,
    id_col=None,
    seed=0,
    weight: str | None = None,
    dims: int | None = None,
    engine: str = "auto",
    cache: bool = True,
    order_free: bool = False,
) -> FCMResult:
    """IT-2: FCM over a whole table, every pass exact over all rows.

    ``eps < 0`` runs exactly ``max_iter`` passes (a shift is never < 0).
    ``order_free`` sums so that the result is the same to the last bit
    however the rows are dealt (one more job, for the largest coordinates,
    and about three times the additions).
    """
    m = check_m(m)
    V0 = resolve_init(
        df, features, k, init, order_col=order_col, id_col=id_col, seed=seed, dims=dims
    )
    pts = to_points(df, features, V0.shape[1], weight)
    pts = drop_incomplete(pts)
    if cache:
        pts = Points(spread(pts.df), pts.dims, pts.weighted)
        pts.df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with loop_frame(pts.df) as rows:
            loop = Points(rows, pts.dims, pts.weighted)
            step = lambda V: fuzzy_pass(loop, V, m, engine)
            if order_free:
                exponents = term_exponents(loop)
                step = lambda V: order_free_pass(loop, V, m, exponents, engine)
            res = iterate(step, V0, eps, max_iter)
    finally:
        if cache:
            pts.df.unpersist()
    if res.n < k:
        raise ValueError(f"{res.n} points cannot make {k} clusters")
    return res


def drop_incomplete(pts: Points) -> Points:
    """A row with a missing coordinate (or weight) is not a point."""
    cond = None
    for x in pts.xs + ([pts.w] if pts.weighted else []):
        c = x.isNotNull()
        cond = c if cond is None else cond & c
    return Points(pts.df.where(cond), pts.dims, pts.weighted)


def weighted_fcm(
    centers_table: DataFrame,
    k: int,
    m: float,
    eps: float,
    max_iter: int,
    init,
    engine: str = "auto",
) -> FCMResult:
    """Weighted FCM whose points are a centre-like table
    ``(features ARRAY<DOUBLE>, w DOUBLE)`` - used by merge and polish."""
    m = check_m(m)
    V0 = np.asarray(init, dtype=float)
    if V0.shape[0] != k:
        raise ValueError(f"need {k} initial centres, got {V0.shape[0]}")
    pts = to_points(centers_table.where(F.col("w") != 0), "features", V0.shape[1], "w")
    pts.df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with loop_frame(pts.df) as rows:
            loop = Points(rows, pts.dims, pts.weighted)
            return iterate(lambda V: fuzzy_pass(loop, V, m, engine), V0, eps, max_iter)
    finally:
        pts.df.unpersist()


# ---- IT-3 --------------------------------------------------------------------


def _fold_schema(dims: int) -> T.StructType:
    return T.StructType(
        [
            T.StructField("c", T.IntegerType(), False),
            T.StructField("features", T.ArrayType(T.DoubleType()), False),
            T.StructField("w", T.DoubleType(), True),
            T.StructField("chunks", T.LongType(), False),
        ]
    )


def first_distinct(X: np.ndarray, k: int) -> np.ndarray:
    """The first k different points (of fewer, the first k rows): equal
    starting centres would stay equal for good."""
    _, at = np.unique(X, axis=0, return_index=True)
    return X[np.sort(at)[:k]] if len(at) >= k else X[:k]


def _fold_local(
    pts: Points, order_cols, V0, k, rows_per_chunk, m, eps, max_iter, round_weights, group, distinct=False
) -> DataFrame:
    """The fold of a bounded table inside one task per group (grouped Arrow).
    With ``V0=None`` the first k rows in order (with ``distinct``, the first
    k different ones) are the initial centres, taken in the same task (no
    separate job); fewer rows give no output."""
    D = pts.dims
    V0 = None if V0 is None else np.asarray(V0, dtype=float)
    schema = _fold_schema(D)

    def run(table: pa.Table) -> pa.Table:
        # the order of the row index: nulls first, ties by the coordinates
        keys = [*order_cols, *map(xname, range(D))]
        idx = pa.compute.sort_indices(
            table.select(keys), sort_keys=[(c, "ascending") for c in keys], null_placement="at_start"
        )
        table = table.take(idx)
        X = np.column_stack(
            [table.column(xname(j)).to_numpy().astype(float) for j in range(D)]
        )
        start = V0
        if start is None:
            if X.shape[0] < k:
                return schema_empty()
            start = first_distinct(X, k) if distinct else X[:k]
        state = kernels.Fold(np.array(start, dtype=float), m, eps, max_iter, round_weights)
        for lo in range(0, X.shape[0], rows_per_chunk):
            state.chunk(X[lo : lo + rows_per_chunk])
        V, W, chunks = state.V, state.W, state.chunks
        return pa.Table.from_pydict(
            {
                "c": pa.array(range(V.shape[0]), pa.int32()),
                "features": pa.array([list(map(float, r)) for r in V], pa.list_(pa.float64())),
                "w": pa.array(W.astype(float), pa.float64()),
                "chunks": pa.array([chunks] * V.shape[0], pa.int64()),
            }
        )

    def schema_empty() -> pa.Table:
        return pa.Table.from_pydict(
            {
                "c": pa.array([], pa.int32()),
                "features": pa.array([], pa.list_(pa.float64())),
                "w": pa.array([], pa.float64()),
                "chunks": pa.array([], pa.int64()),
            }
        )

    return (
        pts.df.select(group.alias("__g"), *order_cols, *pts.xs)
        .groupBy("__g")
        .applyInArrow(run, schema)
    )


def fcm_chunked(
    df: DataFrame,
    features,
    k: int,
    rows_per_chunk: int,
    order_col: str | Sequence[str],
    m: float = 2.0,
    eps: float = 1e-3,
    max_iter: int = 100,
    init="first",
    *,
    dims: int | None = None,
    round_weights: bool = False,
    mode: str = "distributed",
    engine: str = "auto",
) -> FCMResult:
    """IT-3: chunk-fold FCM.  Rows in ``order_col`` order are cut into
    chunks of ``rows_per_chunk``; FCM runs on each chunk from the current
    centres, and from the second chunk on a weighted FCM over the 2C
    points {current, previous} (current first) starts from the current
    centres.  The fold is sequential over chunks.

    Rows that tie on the order are taken in the order of their coordinates;
    null order keys come first.

    ``mode='distributed'`` sorts the table into a row index and streams runs
    of chunks through one task after another (chunks too large for a task
    are folded by distributed passes); ``'local'`` folds a bounded input,
    such as a sample, in one task without the index.  All give the same
    answer.
    """
    m = check_m(m)
    rows_per_chunk = int(rows_per_chunk)
    if rows_per_chunk < 1:
        raise ValueError("rows_per_chunk must be >= 1")
    order_cols = [order_col] if isinstance(order_col, str) else list(order_col)
    k = int(k)
    distinct = isinstance(init, str) and init == "distinct"
    if distinct and mode != "local":
        raise ValueError("init='distinct' is for mode='local'")
    if distinct or isinstance(init, str) and init == "first":
        V0 = None  # the first k rows, taken where the fold runs
        pts = drop_incomplete(to_points(df, features, dims, keep=order_cols))
    else:
        V0 = resolve_init(df, features, k, init, order_col=order_cols, dims=dims)
        pts = drop_incomplete(to_points(df, features, V0.shape[1], keep=order_cols))
    if mode == "local":
        out = _fold_local(
            pts, order_cols, V0, k, rows_per_chunk, m, eps, max_iter, round_weights, F.lit(0), distinct
        ).collect()
        if not out:
            raise ValueError(f"need {k} initial centres: the table has fewer complete rows")
        out = sorted(out, key=lambda r: r["c"])
        V = np.array([r["features"] for r in out], dtype=float)
        W = np.array([r["w"] for r in out], dtype=float)
        return FCMResult(V, W, int(out[0]["chunks"]), float("nan"))
    if mode != "distributed":
        raise ValueError(f"unknown mode {mode!r}")
    if V0 is None:
        V0 = resolve_init(df, features, k, "first", order_col=order_cols, dims=pts.dims)
    return _fold_distributed(
        pts, order_cols, V0, rows_per_chunk, m, eps, max_iter, round_weights, engine
    )


#: A chunk of at most this many coordinates (rows x D, ~64 MB) is folded
#: inside a task; a larger one by distributed passes.
CHUNK_LOCAL_CELLS = 8_000_000
#: Coordinates (~512 MB) that one job of the fold streams through its task.
FOLD_JOB_CELLS = 64_000_000


def _fold_distributed(pts, order_cols, V0, rows_per_chunk, m, eps, max_iter, round_weights, engine):
    """The fold over a row-indexed table.  It is sequential by definition;
    what is spread over the cluster is the sort, and either the passes of a
    large chunk, or nothing: small chunks stream in order through one task
    per run of chunks, which starts from the centres that the run before
    left.  A task holds one chunk; the driver holds the centres between two
    jobs, so a lost executor costs one run of chunks."""
    indexed = row_index(pts.df, [*order_cols, *map(xname, range(pts.dims))])
    n, D = indexed.n, pts.dims
    state = kernels.Fold(np.asarray(V0, dtype=float), m, eps, max_iter, round_weights)
    if rows_per_chunk * D > CHUNK_LOCAL_CELLS:
        for lo in range(0, n, rows_per_chunk):
            # The range filter reaches parquet (row groups of other chunks are
            # skipped); the chunk is kept while its passes run.
            chunk = Points(indexed.slice(lo, lo + rows_per_chunk).select(*pts.xs), D, False)
            chunk.df.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                r = iterate(lambda C_: fuzzy_pass(chunk, C_, m, engine), state.V, eps, max_iter)
            finally:
                chunk.df.unpersist()
            state.merge(r.centers, r.weights)
        return FCMResult(state.V, state.W, state.chunks, float("nan"), n)
    step = max(1, FOLD_JOB_CELLS // (rows_per_chunk * D)) * rows_per_chunk
    for lo in range(0, n, step):
        state = _fold_run(indexed.slice(lo, lo + step, keep_order=True), D, state, rows_per_chunk)
    return FCMResult(state.V, state.W, state.chunks, float("nan"), n)


def _fold_run(rows: DataFrame, D: int, state: kernels.Fold, rows_per_chunk: int) -> kernels.Fold:
    """Fold the chunks of ``rows`` (tagged, whole chunks) in their order."""
    xs = [xname(j) for j in range(D)]

    def run(batches):
        held, size = [], 0
        for b in batches:
            X = np.column_stack([b.column(x).to_numpy(zero_copy_only=False) for x in xs]).astype(float, copy=False)
            while len(X):
                take = X[: rows_per_chunk - size]
                held.append(take)
                size, X = size + len(take), X[len(take) :]
                if size == rows_per_chunk:
                    state.chunk(np.vstack(held))
                    held, size = [], 0
        if size:
            state.chunk(np.vstack(held))
        k = len(state.V)
        yield pa.RecordBatch.from_pydict(
            {
                "c": pa.array(range(k), pa.int32()),
                "features": pa.array([list(map(float, r)) for r in state.V], pa.list_(pa.float64())),
                "w": pa.array(state.W.astype(float), pa.float64()),
                "chunks": pa.array([state.chunks] * k, pa.int64()),
            }
        )

    # one task, rows in order: what a task sorts is spilled, not held
    ordered = rows.coalesce(1).sortWithinPartitions(MID).select(*xs)
    got = sorted(ordered.mapInArrow(run, _fold_schema(D)).collect(), key=lambda r: r["c"])
    V = np.array([r["features"] for r in got], dtype=float)
    return state.at(V, np.array([r["w"] for r in got], dtype=float), int(got[0]["chunks"]))


# ---- IT-8 --------------------------------------------------------------------


def seed_centers(
    df: DataFrame,
    features,
    k: int,
    strategy: str = "chunked",
    *,
    sample_rows: int = 10_000,
    order_col,
    seed=0,
    id_col=None,
    m: float = 2.0,
    eps: float = 1e-3,
    max_iter: int = 100,
    dims: int | None = None,
    sample: str = "uniform",
    unique_id: bool = False,
) -> FCMResult:
    """IT-8: seeds from a sample of at most ``sample_rows`` rows; the first
    k different sampled points start FCM over the whole sample ('whole') or the chunk
    fold with chunks of k rows ('chunked').  Either runs inside one task:
    the sample is bounded.

    ``sample='uniform'`` draws from the whole table by a seeded hash of
    ``id_col`` (or ``order_col``) and takes the rows in hash order (LM-3),
    copies of a row each on their own (``unique_id``: the key never repeats);
    ``'prefix'`` walks the table in ``order_col`` order and keeps rows on a
    coin flip (LM-1): it sees about the first 2 x ``sample_rows`` rows only.
    """
    # The sample is bounded by sample_rows; keep it so the seeding steps
    # below do not recompute it from the table.
    need = []
    for c in ([features] if isinstance(features, str) else list(features)) + (
        [order_col] if isinstance(order_col, str) else list(order_col)
    ) + ([] if id_col is None else [id_col] if isinstance(id_col, str) else list(id_col)):
        if c not in need:
            need.append(c)
    if sample == "prefix":
        rows = sampling.coin_flip_sample(df.select(*need), sample_rows, order_col, seed, id_col)
        order = order_col
    elif sample == "uniform":
        # complete points only, as the passes see them
        names = [features] if isinstance(features, str) else list(features)
        known = df.select(*need)
        for c in names:
            known = known.where(F.col(c).isNotNull())
        if isinstance(features, str) and dims is not None:
            known = known.where(F.size(features) == dims)
        key = order_col if id_col is None else id_col
        rows = sampling.sample_k(known, sample_rows, seed, key, names, unique_id=unique_id, keep_key="__h")
        order = ["__h"]
    else:
        raise ValueError(f"unknown sample {sample!r}")
    sample = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if strategy == "whole":
            # one chunk: FCM over the whole sample, in the task that holds it
            return fcm_chunked(
                sample, features, k, sample_rows, order, m, eps, max_iter, "distinct",
                dims=dims, mode="local",
            )
        if strategy == "chunked":
            return fcm_chunked(
                sample, features, k, k, order, m, eps, max_iter, "distinct",
                dims=dims, mode="local",
            )
        raise ValueError(f"unknown strategy {strategy!r}")
    finally:
        sample.unpersist()
