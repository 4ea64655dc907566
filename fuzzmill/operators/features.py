"""Turning a user table into the working point table.

Users name their feature columns (scalar numeric columns) or hand one
ARRAY column plus its width.  Internally a point is the projection
``(__x0 .. __x{D-1} DOUBLE[, __w DOUBLE])``: only these columns survive,
so the parquet scan reads just the feature (and weight) columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import estimated_tasks

W = "__w"


def xname(j: int) -> str:
    return f"__x{j}"


@dataclass(frozen=True)
class Points:
    """A projected point table and its width."""

    df: DataFrame
    dims: int
    weighted: bool

    @property
    def xs(self) -> list[Column]:
        return [F.col(xname(j)) for j in range(self.dims)]

    @property
    def w(self) -> Column | None:
        return F.col(W) if self.weighted else None


def _array_width(df: DataFrame, col: str) -> int:
    n = F.size(F.col(col))
    row = df.where(F.col(col).isNotNull()).agg(F.min(n).alias("lo"), F.max(n).alias("hi")).first()
    if row["lo"] is None:
        raise ValueError(f"cannot infer the width of {col!r} from an empty table")
    if row["lo"] != row["hi"]:
        raise ValueError(f"{col!r} has widths {row['lo']} to {row['hi']}: give dims; rows of another width are dropped")
    return int(row["lo"])


def to_points(
    df: DataFrame,
    features: str | Sequence[str],
    dims: int | None = None,
    weight: str | None = None,
    keep: Sequence[str] = (),
) -> Points:
    """Project ``df`` to the working point table.

    ``features`` is either a list of numeric column names, or the name of
    one ARRAY column (then ``dims`` is its width; if not given, the one
    width that all rows have).  Rows of another width are dropped, as lines
    of another width are; ``wrong_width`` counts them.  ``weight`` names an optional weight column.  ``keep``
    lists extra columns (ids, chunk keys) carried along unchanged.
    """
    if isinstance(features, str):
        field = df.schema[features]
        if field.dataType.typeName() != "array":
            features = [features]
    if isinstance(features, str):
        d = dims if dims is not None else _array_width(df, features)
        arr = F.col(features)
        df = df.where(F.size(arr) == d)
        xs = [arr.getItem(j).cast("double").alias(xname(j)) for j in range(d)]
    else:
        features = list(features)
        if not features:
            raise ValueError("no feature columns given")
        d = len(features)
        if dims is not None and dims != d:
            raise ValueError(f"dims={dims} but {d} feature columns given")
        xs = [F.col(c).cast("double").alias(xname(j)) for j, c in enumerate(features)]
    cols = [F.col(k) for k in keep] + xs
    if weight is not None:
        cols.append(F.col(weight).cast("double").alias(W))
    return Points(df.select(*cols), d, weight is not None)


def wrong_width(df: DataFrame, features: str, dims: int) -> int:
    """Rows whose ARRAY column is not ``dims`` wide (null counts)."""
    n = F.size(F.col(features))
    return df.where(n.isNull() | (n != dims)).count()


#: Tables of at least this many splits for each core are not dealt anew.
SPREAD_SPLITS = 2


def spread(df: DataFrame) -> DataFrame:
    """Spread a small table over the cluster's cores before it is cached
    for a loop: a single-row-group file would otherwise run every pass in
    one task.  Passes sum over all rows, so this changes no result."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if estimated_tasks(df) < SPREAD_SPLITS * par:
        return df.repartition(par)
    return df
