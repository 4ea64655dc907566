"""One distributed FCM pass (AG-1 .. AG-6, SET-1).

A pass reduces the whole point table to C x (D + 1) sums.  Two engines
give the same sums:

* ``expr``  - the memberships are unrolled into column expressions over
  literal centres, followed by one global ``agg`` of C x (D + 1) sums.
  Catalyst plans it as scan -> project -> partial HashAggregate per task
  -> one-row-per-task exchange -> final HashAggregate, all inside
  whole-stage codegen.  No row blow-up and no per-row Python.
* ``arrow`` - ``mapInArrow`` runs a numpy kernel over each Arrow batch and
  yields one row of partial sums per task, then the same global ``agg``.
  Cheaper to compile when C x D is large (wide points).

Either way the shuffle carries one small row per task, the driver
receives one row per pass, and the plan is rebuilt from the cached base
each pass, so lineage never grows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.kernels import RATIO_BELOW_M
from ..functions.fcm_math import (
    guarded_distance,
    guarded_distance_sql,
    inverse_sum_sql,
    membership_m_sql,
    powered_sql,
)
from .features import W, Points, xname

# Above this many C x D cells the Arrow engine is used by default.  Measured
# on 6M cached rows (8 cores): the expression engine is faster at C x D =
# 12, level at 16-24, and ~7x slower at 40, where the generated aggregate
# method grows past what the JIT compiles.
EXPR_MAX_CELLS = 24


@dataclass
class PassResult:
    sums: np.ndarray  # C x D, sum_k w_k um_ik x_kj
    weights: np.ndarray  # C, sum_k w_k um_ik
    count: int  # points seen


def check_m(m: float) -> float:
    m = float(m)
    if not m > 1.0:
        raise ValueError(f"fuzziness m must be > 1, got {m}")
    return m


def _names(C: int, D: int):
    s = [[f"s{i}_{j}" for j in range(D)] for i in range(C)]
    w = [f"w{i}" for i in range(C)]
    return s, w


def _memberships(points: Points, centers: np.ndarray, m: float) -> DataFrame:
    """Adds __u0 .. __u{C-1} = w * um_i to the point table (lazy).  Three
    projections so each distance and S is computed once per row."""
    C, D = centers.shape
    xs = [xname(j) for j in range(D)]
    base = xs + ([W] if points.weighted else [])
    if m < RATIO_BELOW_M:
        return _memberships_ratio(points, centers, m, base)
    ns = [
        f"{powered_sql(guarded_distance_sql(xs, centers[i]), m)} AS __n{i}" for i in range(C)
    ]
    step1 = points.df.selectExpr(*base, *ns)
    nc = [f"__n{i}" for i in range(C)]
    step2 = step1.selectExpr(*base, *nc, f"{inverse_sum_sql(nc)} AS __s")
    wmul = f" * {W}" if points.weighted else ""
    us = [f"{membership_m_sql('__s', nc[i], m)}{wmul} AS __u{i}" for i in range(C)]
    return step2.selectExpr(*xs, *us)


def _memberships_ratio(points: Points, centers: np.ndarray, m: float, base) -> DataFrame:
    """Near m = 1, d^(2/(m-1)) overflows; S * n_i = sum_j (d_i / d_j)^e
    gives the same memberships from distance ratios."""
    C, D = centers.shape
    xs = [xname(j) for j in range(D)]
    e = 2.0 / (m - 1.0)
    ds = [f"{guarded_distance_sql(xs, centers[i])} AS __d{i}" for i in range(C)]
    step1 = points.df.selectExpr(*base, *ds)
    wmul = f" * {W}" if points.weighted else ""
    us = []
    for i in range(C):
        t = " + ".join(f"POWER(__d{i} / __d{j}, {e!r}D)" for j in range(C))
        us.append(f"POWER({t}, {-float(m)!r}D){wmul} AS __u{i}")
    return step1.selectExpr(*xs, *us)


def sums_expr(points: Points, centers: np.ndarray, m: float) -> DataFrame:
    """AG-1 / AG-2 as a lazy one-row DataFrame (expression engine)."""
    C, D = centers.shape
    sn, wn = _names(C, D)
    u = _memberships(points, centers, m)
    aggs = []
    for i in range(C):
        aggs += [f"SUM(__u{i} * {xname(j)}) AS {sn[i][j]}" for j in range(D)]
        aggs.append(f"SUM(__u{i}) AS {wn[i]}")
    aggs.append("COUNT(1) AS n")
    return u.selectExpr(*aggs)


LONG_SCHEMA = T.StructType(
    [T.StructField("cell", T.IntegerType(), False), T.StructField("v", T.DoubleType(), False)]
)


def long_partials(cells: np.ndarray) -> pa.RecordBatch:
    """One task's partial sums as (cell, v) rows."""
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(cells.size, dtype=np.int32)), pa.array(cells.astype(float))],
        schema=pa.schema([("cell", pa.int32(), False), ("v", pa.float64(), False)]),
    )


def reduce_long(partials: DataFrame, cells: int | None = None) -> DataFrame:
    """Sum long-format partials per cell: a C x (D + 1)-row result whatever
    the number of tasks; the plan does not grow with C x D.  Each task
    already emits one row per cell, so a map-side combine gains nothing:
    the rows are hash-partitioned on ``cell`` into at most min(cells,
    parallelism) partitions (not the session's shuffle default) and summed
    there."""
    if cells is not None:
        par = partials.sparkSession.sparkContext.defaultParallelism
        partials = partials.repartition(max(1, min(int(cells), par)), "cell")
    return partials.groupBy("cell").agg(F.sum("v").alias("v"))


# Per-task partial cells are brought back as they are (one stage, no
# shuffle) while tasks x cells stays under this many rows; beyond it they
# are summed per cell by Spark first.
DIRECT_MAX_ROWS = 200_000


def point_center_pairs(points: Points, centers, keep: Sequence[str] = ()) -> DataFrame:
    """JN-1: every point with every centre: the ``keep`` columns, ``c`` and
    the guarded distance ``d``.  The C centres are literals in the plan, so
    the pairs come from a C-wide generator on each row: no join, no
    broadcast, no shuffle."""
    ds = [guarded_distance(points.xs, [float(v) for v in row]) for row in np.asarray(centers, dtype=float)]
    pairs = points.df.select(*keep, F.posexplode(F.array(*ds)).alias("c", "d"))
    return pairs.withColumn("c", F.col("c").cast("int"))


def splits(points: Points) -> int:
    """Partitions of a point table, asked once for a loop over it."""
    held = points.df.__dict__
    if "_splits" not in held:
        held["_splits"] = points.df.rdd.getNumPartitions()
    return held["_splits"]


def collect_cells(partials: DataFrame, cells: int, tasks: int) -> np.ndarray:
    """Total of long-format partial cells ``(cell, v)``.  The number of rows
    is checked before anything is collected: tasks x cells."""
    out = np.zeros(cells)
    if tasks * cells <= DIRECT_MAX_ROWS:
        rows = partials.collect()
    else:
        rows = reduce_long(partials, cells).collect()
    for r in rows:
        out[r["cell"]] += r["v"]
    return out


def partials_arrow(points: Points, centers: np.ndarray, m: float) -> DataFrame:
    """Per-task partial cells (cell, v) of one pass, numpy over Arrow."""
    C, D = centers.shape
    V = np.array(centers, dtype=float)
    weighted = points.weighted

    def run(batches):
        sums = np.zeros((C, D))
        wts = np.zeros(C)
        n = 0
        for rb in batches:
            if rb.num_rows == 0:
                continue
            XT = np.vstack(
                [rb.column(xname(j)).to_numpy(zero_copy_only=False) for j in range(D)]
            ).astype(float, copy=False)
            w = rb.column(W).to_numpy(zero_copy_only=False) if weighted else None
            s, ws = kernels.fuzzy_sums_t(XT, w, V, m)
            sums += s
            wts += ws
            n += rb.num_rows
        yield long_partials(np.concatenate([sums.ravel(), wts, [float(n)]]))

    cols = [*points.xs] + ([points.w] if weighted else [])
    return points.df.select(*cols).mapInArrow(run, LONG_SCHEMA)


def sums_arrow(points: Points, centers: np.ndarray, m: float) -> DataFrame:
    """AG-1 / AG-2 with numpy over Arrow batches: each task yields its
    C x (D + 1) + 1 partial cells as (cell, v) rows; one ``groupBy(cell)``
    adds them up."""
    C, D = np.asarray(centers).shape
    return reduce_long(partials_arrow(points, centers, m), C * D + C + 1)


def sums_frame(points: Points, centers, m: float, engine: str = "auto") -> DataFrame:
    centers = np.asarray(centers, dtype=float)
    if engine == "auto":
        engine = "expr" if centers.size <= EXPR_MAX_CELLS else "arrow"
    if engine == "expr":
        return sums_expr(points, centers, m)
    if engine == "arrow":
        # Same one-row wide shape as the expression engine: pivot the
        # long cells on their known ids (a single PivotFirst aggregate).
        C, D = centers.shape
        sn, wn = _names(C, D)
        names = [x for row in sn for x in row] + wn + ["n"]
        wide = (
            sums_arrow(points, centers, m)
            .groupBy()
            .pivot("cell", list(range(len(names))))
            .agg(F.first("v"))
        )
        return wide.select(
            *[F.col(f"`{i}`").alias(n) for i, n in enumerate(names[:-1])],
            F.col(f"`{len(names) - 1}`").cast("long").alias("n"),
        )
    raise ValueError(f"unknown engine {engine!r}")


def fuzzy_pass(points: Points, centers, m: float, engine: str = "auto") -> PassResult:
    """Run one pass and bring back the C x (D + 1) sums."""
    m = check_m(m)
    centers = np.asarray(centers, dtype=float)
    C, D = centers.shape
    if D != points.dims:
        raise ValueError(f"centres have width {D}, points {points.dims}")
    if engine == "auto":
        engine = "expr" if centers.size <= EXPR_MAX_CELLS else "arrow"
    if engine == "arrow":
        cells = collect_cells(partials_arrow(points, centers, m), C * D + C + 1, splits(points))
        sums, wts, n = cells[: C * D].reshape(C, D), cells[C * D : C * D + C], int(cells[-1])
    else:
        row = sums_frame(points, centers, m, engine).collect()[0]
        sn, wn = _names(C, D)
        n = int(row["n"] or 0)
        sums = np.array([[row[sn[i][j]] or 0.0 for j in range(D)] for i in range(C)], dtype=float)
        wts = np.array([row[wn[i]] or 0.0 for i in range(C)], dtype=float)
    if n == 0:
        raise ValueError("the point table is empty")
    if np.isnan(sums).any() or np.isnan(wts).any():
        raise ValueError("a pass produced NaN: the points contain NaN or infinite values")
    return PassResult(sums, wts, n)


# ---- order-free sums -----------------------------------------------------------

#: Bits of a slice, and slices of a term: sums of whole numbers below
#: 2**SLICE stay exact for 2**43 rows.
SLICE, SLICES = 20, 3


def term_exponents(points: Points) -> list[int]:
    """For each coordinate and, last, the weight: an e such that no term of
    its sums (membership x weight x coordinate) reaches 2**e.  One job."""
    most = [F.max(F.abs(x)) for x in points.xs] + [F.max(F.abs(points.w)) if points.weighted else F.lit(1.0)]
    row = points.df.agg(*(c.alias(f"m{j}") for j, c in enumerate(most))).first()
    m = [float(v or 0.0) for v in row]
    if not np.isfinite(m).all():
        raise ValueError("a pass produced NaN: the points contain NaN or infinite values")
    bounds = [v * m[-1] for v in m[:-1]] + [m[-1]]
    return [int(np.frexp(v)[1]) for v in bounds]


def _whole(slices: Sequence[int], e: int) -> float:
    """The number whose slice sums these are, rounded once."""
    total = 0
    for v in slices:
        total = (total << SLICE) + int(v)
    return float(np.ldexp(float(total), e - SLICE * SLICES))


def order_free_pass(points: Points, centers, m: float, exponents: Sequence[int], engine: str = "auto") -> PassResult:
    """``fuzzy_pass`` whose result does not depend on how rows are dealt or
    in which order partial sums meet.  Every term is cut into whole numbers
    of SLICE bits (exact in doubles, since the scale is a power of two), the
    slices are summed as integers, and the total is rounded once.  A term
    keeps SLICE x SLICES bits below the largest possible one."""
    m = check_m(m)
    V = np.asarray(centers, dtype=float)
    C, D = V.shape
    if engine == "auto":
        engine = "expr" if V.size <= EXPR_MAX_CELLS else "arrow"
    cells = [(i, j) for i in range(C) for j in range(D + 1)]
    scale = [float(np.ldexp(1.0, SLICE - e)) for e in exponents]
    if engine == "expr":
        step = f"{float(1 << SLICE)!r}D"
        terms = [f"__u{i} * {xname(j)} * {scale[j]!r}D" if j < D else f"__u{i} * {scale[D]!r}D" for i, j in cells]
        df = _memberships(points, V, m).selectExpr(*(f"{t} AS t{k}" for k, t in enumerate(terms)))
        names = [f"t{k}" for k in range(len(cells))]
        for q in range(SLICES):  # split the whole part off, scale the rest up
            done = [c for c in df.columns if c not in names]
            whole = [f"CAST(FLOOR({t}) AS BIGINT) AS {t}_{q}" for t in names]
            df = df.selectExpr(*done, *whole, *(f"({t} - FLOOR({t})) * {step} AS {t}" for t in names))
        df = df.drop(*names)
        row = df.selectExpr(*(f"SUM({c}) AS {c}" for c in df.columns), "COUNT(1) AS n").collect()[0]
        found, n = [[row[f"t{k}_{s}"] or 0 for s in range(SLICES)] for k in range(len(cells))], int(row["n"])
    elif engine == "arrow":
        found, n = _order_free_arrow(points, V, m, scale)
    else:
        raise ValueError(f"unknown engine {engine!r}")
    if n == 0:
        raise ValueError("the point table is empty")
    values = np.array([_whole(f, exponents[j]) for f, (_, j) in zip(found, cells)]).reshape(C, D + 1)
    return PassResult(values[:, :D], values[:, D], n)


def _order_free_arrow(points: Points, V: np.ndarray, m: float, scale: Sequence[float]):
    C, D = V.shape
    size, weighted = C * (D + 1), points.weighted

    def run(batches):
        total, n = np.zeros((size, SLICES), np.int64), 0
        for rb in batches:
            if rb.num_rows == 0:
                continue
            xt = [rb.column(xname(j)).to_numpy(zero_copy_only=False).astype(float) for j in range(D)]
            w = rb.column(W).to_numpy(zero_copy_only=False).astype(float) if weighted else None
            um = kernels.memberships_t(xt, w, V, m)
            for i in range(C):
                for j in range(D + 1):
                    t = (um[i] * xt[j] if j < D else um[i]) * scale[j]
                    for s in range(SLICES):
                        whole = np.floor(t)
                        total[i * (D + 1) + j, s] += int(whole.astype(np.int64).sum())
                        t = (t - whole) * float(1 << SLICE)
            n += rb.num_rows
        cells = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells.size, dtype=np.int32)), pa.array(cells)], names=["cell", "v"])

    cols = [*points.xs] + ([points.w] if points.weighted else [])
    partials = points.df.select(*cols).mapInArrow(run, "cell INT, v BIGINT")
    rows = partials.groupBy("cell").agg(F.sum("v").alias("v")).collect()  # C x (D + 1) x SLICES + 1 rows
    out = np.zeros(size * SLICES + 1, object)
    for r in rows:
        out[r["cell"]] = int(r["v"])
    return out[:-1].reshape(size, SLICES).tolist(), int(out[-1])


def new_centers(result: PassResult, old) -> np.ndarray:
    """AG-4: ratio of sums; a centre with zero weight keeps its position."""
    return kernels.update(result.sums, result.weights, np.asarray(old, dtype=float))


def max_shift(old, new) -> float:
    """AG-5: largest absolute coordinate move between two centre sets."""
    return kernels.shift(np.asarray(old, dtype=float), np.asarray(new, dtype=float))


# ---- DataFrame forms over centre tables -----------------------------------


def centers_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField("c", T.IntegerType(), False),
            T.StructField("features", T.ArrayType(T.DoubleType(), False), False),
            T.StructField("w", T.DoubleType(), True),
        ]
    )


def centers_df(spark, centers, weights=None) -> DataFrame:
    """A centre table (c INT, features ARRAY<DOUBLE>, w DOUBLE)."""
    centers = np.asarray(centers, dtype=float)
    rows = [
        (
            i,
            [float(v) for v in centers[i]],
            None if weights is None else float(weights[i]),
        )
        for i in range(centers.shape[0])
    ]
    return spark.createDataFrame(rows, centers_schema())


def new_centers_df(sums: DataFrame, old: DataFrame) -> DataFrame:
    """AG-4 over tables: ``sums(c, s ARRAY<DOUBLE>, w)`` and the old centre
    table -> new centres; a zero-weight centre keeps its old coordinates."""
    j = sums.alias("s").join(old.alias("o"), F.col("s.c") == F.col("o.c"))
    feats = F.when(
        F.col("s.w") == 0, F.col("o.features")
    ).otherwise(F.transform(F.col("s.s"), lambda v: v / F.col("s.w")))
    return j.select(F.col("s.c").alias("c"), feats.alias("features"), F.col("s.w").alias("w"))


def max_shift_df(old: DataFrame, new: DataFrame) -> DataFrame:
    """AG-5 over tables: one row, ``shift`` = max |old - new| over c, j."""
    j = old.alias("o").join(new.alias("n"), F.col("o.c") == F.col("n.c"))
    per = F.array_max(
        F.zip_with(F.col("o.features"), F.col("n.features"), lambda a, b: F.abs(a - b))
    )
    return j.agg(F.max(per).alias("shift"))


def total_weight(centers: DataFrame) -> DataFrame:
    """AG-6: total weight of a centre table."""
    return centers.agg(F.sum("w").alias("total_w"))


def stack(cur: DataFrame, prev: DataFrame, k: int | None = None) -> DataFrame:
    """SET-1: current and previous weighted centres as 2C points, current
    first (``c`` of the previous set is shifted by C)."""
    k = cur.count() if k is None else int(k)
    return cur.select("c", "features", "w").unionByName(
        prev.select((F.col("c") + F.lit(k)).alias("c"), "features", "w")
    )
