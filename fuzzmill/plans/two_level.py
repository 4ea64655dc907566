"""Two-level FCM (IT-4 .. IT-7): cluster each block locally to convergence,
then cluster the small weighted summaries.

Plan at scale:

* **partial (IT-4)** - by default a block is a bounded run of at most
  ``block_rows`` consecutive rows of one input partition (default: 8M
  coordinates / D), handled by
  ``mapInArrow``: no shuffle of points at all, each task emits C rows per
  block.  With ``block_col`` the blocks are the groups of that key
  (the same whatever the layout): points are shuffled once by the key and
  every group is clustered by ``applyInArrow``.  The points of a key that
  holds more than ``block_rows`` rows are counted and cut into sub-blocks
  by a hash of their coordinates first, so no group is unbounded even when
  one key holds a third of the table.
* **merge (IT-5)** - weighted FCM over the partial rows (C per block),
  starting from the seeds; distributed passes over a small table.
* **polish (IT-6)** - weighted FCM of the C merged centres starting at
  themselves.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..operators.features import Points, to_points, xname
from ..operators.passes import check_m
from ..operators.sampling import hash_key
from ..session import scratch_path
from .fcm import FCMResult, drop_incomplete, resolve_init, seed_centers, weighted_fcm

# A hot-key table (one row per key with more than block_rows rows) is
# broadcast only up to this many rows; beyond it the heaviest are, and the
# join on the others shuffles.
BROADCAST_MAX_ROWS = 100_000
# Default block size: at most this many coordinates (rows x D, ~64 MB of
# doubles) per block; narrow points get long blocks (few partial rows),
# wide points shorter ones.
BLOCK_CELLS = 8_000_000
BLOCK_ROWS = None
# The merge runs inside one task when the partial table (C rows per block)
# holds at most this many coordinates (rows x D, ~32 MB); beyond it, as
# distributed passes.
MERGE_LOCAL_MAX_CELLS = 4_000_000


NO_WEIGHT = "all partial weights are zero: nothing to merge (round_weights=False keeps small ones)"


def partial_schema(block: T.DataType | None = None) -> T.StructType:
    return T.StructType(
        [
            T.StructField("block", block or T.LongType(), True),
            T.StructField("sub", T.LongType(), False),
            T.StructField("c", T.IntegerType(), False),
            T.StructField("features", T.ArrayType(T.DoubleType(), False), False),
            T.StructField("w", T.DoubleType(), True),
            T.StructField("n", T.LongType(), False),
            T.StructField("passes", T.IntegerType(), False),
        ]
    )


def _emit(block: pa.Scalar, sub: int, V, W, n: int, passes: int) -> pa.RecordBatch:
    """C partial rows of one block; ``block`` is the key itself (typed; may
    be null), ``sub`` the sub-block of a split hot key (0 otherwise)."""
    C = V.shape[0]
    return pa.RecordBatch.from_pydict(
        {
            "block": pa.repeat(block, C),
            "sub": pa.array([sub] * C, pa.int64()),
            "c": pa.array(range(C), pa.int32()),
            "features": pa.array([list(map(float, r)) for r in V], pa.list_(pa.float64())),
            "w": pa.array(np.asarray(W, dtype=float), pa.float64()),
            "n": pa.array([n] * C, pa.int64()),
            "passes": pa.array([passes] * C, pa.int32()),
        },
        schema=pa.schema(
            [
                ("block", block.type),
                ("sub", pa.int64(), False),
                ("c", pa.int32(), False),
                ("features", pa.list_(pa.field("element", pa.float64(), False)), False),
                ("w", pa.float64()),
                ("n", pa.int64(), False),
                ("passes", pa.int32(), False),
            ]
        ),
    )


def _columns(batch: pa.RecordBatch, D: int) -> list[np.ndarray]:
    return [batch.column(xname(j)).to_numpy(zero_copy_only=False) for j in range(D)]


def partial_fcm(
    df: DataFrame,
    features,
    seeds,
    m: float = 2.0,
    eps: float = 1e-3,
    max_iter: int = 100,
    *,
    block_col: str | None = None,
    block_rows: int | None = BLOCK_ROWS,
    blocks: int | None = None,
    round_weights: bool = True,
    dims: int | None = None,
) -> DataFrame:
    """IT-4: C weighted centres per block, each block clustered to
    convergence from ``seeds`` (C x D).  Returns the lazy partial table
    ``(block, sub, c, features, w, n, passes)``; weights are rounded
    half-up when ``round_weights``.

    Blocks are runs of rows of one input split (no shuffle; their make-up,
    and with it the answer, follows the input's layout), the rows of one
    ``block_col`` key, or ``blocks`` hash blocks of the coordinates (one
    shuffle; the same blocks whatever the layout).  A key or hash block of
    more than ``block_rows`` rows is clustered as its different points with
    their numbers of copies, in sub-blocks of ``block_rows`` points
    (``sub_blocks``).  ``block`` is the key itself, of its own type."""
    m = check_m(m)
    V0 = np.asarray(seeds, dtype=float)
    D = V0.shape[1]
    block_rows = default_block_rows(D) if block_rows is None else int(block_rows)
    if block_col and blocks:
        raise ValueError("give block_col or blocks, not both")
    keep = [block_col] if block_col else []
    pts = drop_incomplete(to_points(df, features, dims or D, keep=keep))
    if blocks:
        block_col = "__hb0"
        lot = F.conv(F.substring(hash_key([xname(j) for j in range(pts.dims)], "block"), 1, 8), 16, 10).cast("long")
        dealt = F.pmod(lot, F.lit(int(blocks))).alias(block_col)
        pts = Points(pts.df.select(dealt, *pts.xs), pts.dims, False)

    def solve(points, key, sub=0):
        V, W, passes, _ = points.fcm(V0, m, eps, max_iter)
        if round_weights:
            W = np.floor(W + 0.5)
        return _emit(key, sub, V, W, points.weight(), passes)

    if block_col is None:

        def run(batches):
            part = TaskContext.get().partitionId()
            seq = 0
            points = kernels.Block(D, block_rows)
            for rb in batches:
                cols = _columns(rb, D)
                lo = 0
                while lo < rb.num_rows:
                    take = min(block_rows - points.n, rb.num_rows - lo)
                    points.add([c[lo : lo + take] for c in cols])
                    lo += take
                    if points.n >= block_rows:
                        yield solve(points, pa.scalar((part << 24) | seq, pa.int64()))
                        seq += 1
                        points = kernels.Block(D, block_rows)
            if points.n:
                yield solve(points, pa.scalar((part << 24) | seq, pa.int64()))

        return pts.df.select(*pts.xs).mapInArrow(run, partial_schema())

    # Keyed blocks: one group per key, and per sub-block of a hot key.
    schema = partial_schema(pts.df.schema[block_col].dataType)
    counts = pts.df.groupBy(block_col).agg(F.count(F.lit(1)).alias("__cnt"))
    hot = _scratch(counts.where(F.col("__cnt") > block_rows).withColumnRenamed(block_col, "__hot"), "hot-keys")

    # A group comes in batches, which a block takes one by one: a task holds
    # the coordinates of its block once, and no Arrow table of it.
    def run_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = None
        for rb in batches:
            if rb.num_rows == 0:
                continue
            weighted = "__n" in rb.schema.names
            if points is None:
                key, sub = rb.column(block_col)[0], rb.column("__sub")[0].as_py() if weighted else 0
                points = kernels.Block(D, block_rows, weighted)
            points.add(_columns(rb, D), rb.column("__n").to_numpy() if weighted else None)
        if points is not None:
            yield solve(points, key, sub)

    def clustered(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).applyInArrow(run_group, schema)

    if hot.isEmpty():
        return clustered(pts.df, block_col)
    warm, cold = _split_by_key(pts.df, hot, block_col)
    return clustered(cold, block_col).unionByName(clustered(sub_blocks(warm, block_col, pts.dims, block_rows), block_col, "__sub"))


def _scratch(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared scratch folder and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _split_by_key(rows: DataFrame, hot: DataFrame, block_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in ``hot`` and the others (null-safe).  The
    heaviest keys are broadcast; a key beyond BROADCAST_MAX_ROWS heavier
    ones holds a share of the rows too small to hurt a shuffled join."""
    same = F.col(block_col).eqNullSafe(F.col("__hot"))
    if hot.count() <= BROADCAST_MAX_ROWS:
        side = F.broadcast(hot)
        return rows.join(side, same, "left_semi"), rows.join(side, same, "left_anti")
    heavy = F.broadcast(_scratch(hot.orderBy(F.desc("__cnt"), "__hot").limit(BROADCAST_MAX_ROWS), "heavy-keys"))
    light = hot.join(heavy.withColumnRenamed("__hot", "__h"), F.col("__hot").eqNullSafe(F.col("__h")), "left_anti")
    rest = rows.join(heavy, same, "left_anti")
    warm = rows.join(heavy, same, "left_semi").unionByName(rest.join(light, same, "left_semi"))
    return warm, rest.join(light, same, "left_anti")


def sub_blocks(rows: DataFrame, block_col: str, dims: int, block_rows: int) -> DataFrame:
    """The different points of each key with their number of copies ``__n``
    and ``__sub``: a key's points in the order of a hash of their
    coordinates, cut every ``block_rows``.  The cut depends on the rows
    alone, not on their layout, and copies weigh, so a point that stands a
    million times is one row.  Only where a sub-block begins is looked for: a
    histogram of hash prefixes per key gives the prefix, the rank within it
    the hash; a point is placed by the sorted hashes of its key (one for each
    sub-block), so points are dealt once, written once and ranked nowhere."""
    xs = [xname(j) for j in range(dims)]
    lot = hash_key(xs, "block")
    prefix = F.substring(lot, 1, 4)
    points = _scratch(rows.groupBy(block_col, *xs).agg(F.count(F.lit(1)).alias("__n")), "hot-points")
    before = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = points.groupBy(F.col(block_col).alias("__k"), prefix.alias("__p")).agg(F.count(F.lit(1)).alias("__m"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__m").over(before), F.lit(0)))
    begun = F.greatest(F.ceil(F.col("__start") / F.lit(block_rows)), F.lit(1)) * F.lit(block_rows)
    starts = _scratch(starts.where(begun < F.col("__start") + F.col("__m")).select("__k", "__p", "__start"), "hot-prefixes")
    near = points.select(F.col(block_col), lot.alias("__lot"), prefix.alias("__pre"))
    near = near.join(starts, F.col(block_col).eqNullSafe(F.col("__k")) & (F.col("__pre") == F.col("__p")))
    at = F.col("__start") + F.row_number().over(Window.partitionBy("__k", "__p").orderBy("__lot")) - 1
    near = near.withColumn("__at", at).where((F.col("__at") > 0) & (F.col("__at") % block_rows == 0))
    cuts = _scratch(near.groupBy("__k").agg(F.sort_array(F.collect_list("__lot")).alias("__cuts")), "hot-cuts")
    most = cuts.agg(F.max(F.size("__cuts"))).first()[0] or 0
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(max(1, int(most).bit_length())))])

    def place(h):  # binary search: the number of hashes up to h
        step = lambda n, s: F.when(F.get("__cuts", n + s - 1) <= h, n + s).otherwise(n)
        return F.aggregate(steps, F.lit(0), step)

    sub = F.coalesce(F.get(F.transform(F.array(lot), place), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    placed = points.join(cuts, F.col(block_col).eqNullSafe(F.col("__k")), "left")
    return placed.select(block_col, sub.alias("__sub"), "__n", *xs)


def _merge_local(partials: DataFrame, V0, m, eps, max_iter) -> FCMResult:
    """The merge loop inside one task: only for a partial table whose size
    was checked against MERGE_LOCAL_MAX_CELLS."""
    C, D = V0.shape
    out_schema = T.StructType(
        [
            T.StructField("c", T.IntegerType(), False),
            T.StructField("features", T.ArrayType(T.DoubleType()), False),
            T.StructField("w", T.DoubleType(), True),
            T.StructField("passes", T.IntegerType(), False),
            T.StructField("shift", T.DoubleType(), True),
            T.StructField("n", T.LongType(), False),
        ]
    )

    def run(table: pa.Table) -> pa.Table:
        feats = table.column("features").combine_chunks()
        X = np.asarray(feats.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, D)
        w = table.column("w").to_numpy().astype(float)
        V, W, passes, moved = kernels.local_fcm(X, w, V0, m, eps, max_iter)
        return pa.Table.from_pydict(
            {
                "c": pa.array(range(C), pa.int32()),
                "features": pa.array([list(map(float, r)) for r in V], pa.list_(pa.float64())),
                "w": pa.array(W.astype(float), pa.float64()),
                "passes": pa.array([passes] * C, pa.int32()),
                "shift": pa.array([float(moved)] * C, pa.float64()),
                "n": pa.array([X.shape[0]] * C, pa.int64()),
            }
        )

    rows = (
        partials.where(F.col("w") != 0)
        .select(F.lit(0).alias("__g"), "features", "w")
        .groupBy("__g")
        .applyInArrow(run, out_schema)
        .collect()
    )
    if not rows:
        raise ValueError(NO_WEIGHT)
    rows = sorted(rows, key=lambda r: r["c"])
    V = np.array([r["features"] for r in rows], dtype=float)
    W = np.array([r["w"] for r in rows], dtype=float)
    if np.isnan(V).any():
        raise ValueError("merge produced NaN")
    return FCMResult(V, W, int(rows[0]["passes"]), float(rows[0]["shift"]), int(rows[0]["n"]))


def merge_fcm(
    partials: DataFrame, seeds, m: float = 2.0, eps: float = 1e-3, max_iter: int = 100,
    mode: str = "auto",
) -> FCMResult:
    """IT-5: weighted FCM over all partial rows, starting from the seeds;
    weights are not rounded.  ``auto`` runs the loop in one task when the
    partial table holds at most MERGE_LOCAL_MAX_CELLS coordinates (C rows
    per block, so it is small unless the blocks are very many), else as
    distributed passes."""
    m = check_m(m)
    V0 = np.asarray(seeds, dtype=float)
    if mode == "auto":
        n = partials.count()
        mode = "local" if n * V0.shape[1] <= MERGE_LOCAL_MAX_CELLS else "distributed"
    if mode == "local":
        return _merge_local(partials, V0, m, eps, max_iter)
    if partials.where(F.col("w") != 0).isEmpty():
        raise ValueError(NO_WEIGHT)
    return weighted_fcm(partials.select("features", "w"), V0.shape[0], m, eps, max_iter, V0)


def polish(
    spark, centers, weights, m: float = 2.0, eps: float = 1e-3, max_iter: int = 100
) -> FCMResult:
    """IT-6: weighted FCM of the C merged centres, starting at themselves.
    Its input is exactly C weighted points already held by the caller, so
    the loop runs in place; no table is read."""
    m = check_m(m)
    V = np.asarray(centers, dtype=float)
    w = np.asarray(weights, dtype=float)
    keep = w != 0
    Vn, W, passes, moved = kernels.local_fcm(V[keep], w[keep], V, m, eps, max_iter)
    return FCMResult(Vn, W, passes, moved, int(keep.sum()))


def polish_table(merged: DataFrame, m: float = 2.0, eps: float = 1e-3, max_iter: int = 100, engine: str = "auto") -> DataFrame:
    """IT-6 from table to table: a weighted centre table ``(c, features, w)``
    of any size is clustered by distributed weighted passes that start at
    its own centres; the result is a centre table like it.  ``polish`` does
    the same in place for centres that the caller already holds."""
    rows = merged.orderBy("c").select("features").collect()  # the starting centres: C rows
    if not rows:
        raise ValueError("there are no centres to polish")
    V = np.array([r["features"] for r in rows], dtype=float)
    res = weighted_fcm(merged.select("features", "w"), len(V), m, eps, max_iter, V, engine)
    return res.to_df(merged.sparkSession)


@dataclass
class TwoLevelResult(FCMResult):
    seeds: np.ndarray | None = None
    blocks: int = 0
    input_weight: float = 0.0
    partial_passes: int = 0  # of the block that took the most
    merge_passes: int = 0
    polish_passes: int = 0
    lost_points: int = 0  # points of blocks whose weights all rounded to 0
    equal_centers: int = 0  # final centres that lie on an earlier one
    stage_sec: dict = field(default_factory=dict)
    merged_centers: np.ndarray | None = None
    merged_weights: np.ndarray | None = None


def two_level_fcm(
    df: DataFrame,
    features,
    k: int,
    m: float = 2.0,
    eps: float = 1e-3,
    max_iter: int = 100,
    *,
    order_col=None,
    sample_rows: int = 10_000,
    seed=0,
    id_col=None,
    seeding: str = "whole",
    sample: str = "uniform",
    seeds=None,
    block_col: str | None = None,
    block_rows: int | None = BLOCK_ROWS,
    blocks: int | None = None,
    round_weights: bool = True,
    dims: int | None = None,
    unique_id: bool = False,
) -> TwoLevelResult:
    """IT-7: sample + seed (IT-8), partial per block (IT-4), merge (IT-5),
    polish (IT-6).  Unkeyed, the point table is scanned twice in all: once
    by the sample (a top-k, bounded output) and once by the partial stage;
    keyed or hashed blocks add a count per key.  Every later stage works on
    C rows per block.

    ``seeds`` (a C x D matrix or a centre table, as ``read_centers`` gives)
    replaces the sample and seeding.  ``seeding='chunked'`` folds the
    sample in chunks of k rows and may end in equal centres; the default
    'whole' runs FCM over the sample."""
    spark = df.sparkSession
    t = {}
    t0 = time.perf_counter()
    if seeds is not None:
        seeds = resolve_init(df, features, k, seeds, dims=dims)
    else:
        if order_col is None:
            raise ValueError("give order_col (or seeds)")
        seeds = seed_centers(
            df, features, k, seeding, sample_rows=sample_rows, order_col=order_col, seed=seed,
            id_col=id_col, m=m, eps=eps, max_iter=max_iter, dims=dims, sample=sample, unique_id=unique_id,
        ).centers
    t["seed"] = time.perf_counter() - t0
    t0 = time.perf_counter()
    partials = partial_fcm(
        df, features, seeds, m, eps, max_iter, block_col=block_col,
        block_rows=block_rows, blocks=blocks, round_weights=round_weights, dims=dims,
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Blocks and points clustered, in one aggregate over the summaries.
        each = partials.groupBy("block", "sub", "n").agg(F.max("w").alias("w"))
        stats = partials.where(F.col("c") == 0).agg(
            F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("points"), F.max("passes").alias("passes")
        ).collect()[0]
        n_blocks, points = int(stats["blocks"]), int(stats["points"] or 0)
        lost = each.where(F.col("w") == 0).agg(F.sum("n")).first()[0] if round_weights else 0
        t["partial"] = time.perf_counter() - t0
        t0 = time.perf_counter()
        merged = merge_fcm(partials, seeds, m, eps, max_iter)
        t["merge"] = time.perf_counter() - t0
    finally:
        partials.unpersist()
    t0 = time.perf_counter()
    final = polish(spark, merged.centers, merged.weights, m, eps, max_iter)
    t["polish"] = time.perf_counter() - t0
    return TwoLevelResult(
        final.centers, final.weights,
        int(stats["passes"] or 0) + merged.passes + final.passes, final.shift, points,
        partial_passes=int(stats["passes"] or 0), merge_passes=merged.passes, polish_passes=final.passes,
        lost_points=int(lost or 0),
        equal_centers=len(final.centers) - len(np.unique(final.centers.round(9), axis=0)),
        seeds=seeds, blocks=n_blocks, input_weight=float(np.sum(merged.weights)),
        stage_sec={k_: round(v, 3) for k_, v in t.items()},
        merged_centers=merged.centers, merged_weights=merged.weights,
    )


def default_block_rows(dims: int) -> int:
    return max(1_000, BLOCK_CELLS // max(1, int(dims)))
