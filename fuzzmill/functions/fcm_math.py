"""Scalar FCM maths as Spark Column builders (FN-1 .. FN-8).

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions only, so it stays inside whole-stage codegen.  Centres are
small (C x D doubles) and enter the plan as literals; the per-point work
is unrolled over C and D at plan-build time, so no array is allocated per
row and no higher-order function (which Spark interprets rather than
compiles) sits in the hot path.

The formulas, for point x, centre v, fuzziness m:

    sq(a, b) = GUARD if a - b == 0 else (a - b)^2     per coordinate
    d        = sqrt(sum_j sq(x_j, v_j))
    n        = d ^ (2 / (m - 1))
    S        = sum_i 1 / n_i
    um_i     = (S * n_i) ^ (-m)                        membership to the m-th power
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference for equal results:
# a zero coordinate difference counts as (1e-5)^2 = 1e-10.
GUARD = 1e-10


def _col(c) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(float(c))


def guarded_sq(a, b) -> Column:
    """FN-1: squared difference, GUARD when the difference is exactly zero."""
    diff = _col(a) - _col(b)
    return F.when(diff == 0, F.lit(GUARD)).otherwise(diff * diff)


def guarded_distance(xs: Sequence, vs: Sequence) -> Column:
    """FN-2: guarded Euclidean distance between two coordinate lists."""
    if len(xs) != len(vs):
        raise ValueError(f"width mismatch: {len(xs)} vs {len(vs)}")
    total = None
    for x, v in zip(xs, vs):
        term = guarded_sq(x, v)
        total = term if total is None else total + term
    return F.sqrt(total)


def guarded_distance_arrays(x: Column, v: Column) -> Column:
    """FN-2 over two ARRAY<DOUBLE> columns of equal length (no unrolling)."""
    sq = F.zip_with(
        x, v, lambda a, b: F.when(a - b == 0, F.lit(GUARD)).otherwise((a - b) * (a - b))
    )
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, t: acc + t))


def powered(d, m: float) -> Column:
    """FN-3: d ^ (2 / (m - 1)); m = 1 is rejected by the callers."""
    return F.pow(_col(d), F.lit(2.0 / (float(m) - 1.0)))


def inverse_sum(ns: Sequence) -> Column:
    """FN-4: S = sum_i 1 / n_i.  pow(n, -1) gives +inf at n = 0 as Java's
    1/0.0 does, where ANSI division would raise."""
    total = None
    for n in ns:
        term = F.pow(_col(n), F.lit(-1.0))
        total = term if total is None else total + term
    return total


def membership_m(s, n, m: float) -> Column:
    """FN-5: u^m = (S * n_i) ^ (-m)."""
    return F.pow(_col(s) * _col(n), F.lit(-float(m)))


def round_weight(w) -> Column:
    """FN-6: half-up rounding to a whole number as Java's Math.round does
    (floor(w + 0.5)), kept as double."""
    return F.floor(_col(w) + F.lit(0.5)).cast("double")


def abs_shift(a, b) -> Column:
    """FN-7: absolute coordinate shift."""
    return F.abs(_col(a) - _col(b))


def chunk_of(index, rows_per_chunk: int) -> Column:
    """FN-8: chunk number of a 0-based row index (integer division)."""
    return (_col(index).cast("long") / F.lit(int(rows_per_chunk))).cast("long")


def memberships_m(xs: Sequence, centers, m: float) -> list[Column]:
    """um_i for every centre i, as C Column expressions over the point's
    coordinate columns ``xs`` and a literal C x D centre matrix."""
    ns = [
        powered(guarded_distance(xs, [float(v) for v in row]), m) for row in centers
    ]
    s = inverse_sum(ns)
    return [membership_m(s, n, m) for n in ns]


# ---- the same formulas as SQL text ------------------------------------------
# Loops rebuild their plan every pass; SQL text reaches the JVM in one call
# per column, where a tree of Column objects costs one call per node.


def lit_sql(v: float) -> str:
    v = float(v)
    if v != v or v in (float("inf"), float("-inf")):
        raise ValueError(f"centre coordinate is not finite: {v}")
    return f"({v!r}D)"


def guarded_sq_sql(x: str, v: float) -> str:
    d = f"({x} - {lit_sql(v)})"
    return f"CASE WHEN {d} = 0 THEN {GUARD!r}D ELSE {d} * {d} END"


def guarded_distance_sql(xs: Sequence[str], vs: Sequence[float]) -> str:
    return "SQRT(" + " + ".join(guarded_sq_sql(x, v) for x, v in zip(xs, vs)) + ")"


def powered_sql(d: str, m: float) -> str:
    return f"POWER({d}, {2.0 / (float(m) - 1.0)!r}D)"


def inverse_sum_sql(ns: Sequence[str]) -> str:
    return "(" + " + ".join(f"POWER({n}, -1.0D)" for n in ns) + ")"


def membership_m_sql(s: str, n: str, m: float) -> str:
    return f"POWER({s} * {n}, {-float(m)!r}D)"


def sq_distance_sql(xs: Sequence[str], vs: Sequence[float]) -> str:
    """Unguarded squared Euclidean distance (k-means)."""
    return " + ".join(f"({x} - {lit_sql(v)}) * ({x} - {lit_sql(v)})" for x, v in zip(xs, vs))
