"""Text forms of points and centres (PRJ-1, PRJ-2, PRJ-3, PRJ-5, FLT-1, FLT-4).

All built-in column functions: ``split`` with a regex, ``slice``,
``transform`` with a cast, ``concat_ws``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must match the reference: the default point
# separator is one space; centre files are split on runs of whitespace.
DEFAULT_SEP = " "
WS = r"\s+"


def tokenise(line: Column | str, sep: str = DEFAULT_SEP) -> Column:
    """PRJ-1: split ``line`` on the regex ``sep`` and drop trailing empty
    tokens, as Java's ``String.split`` does: ``1,2,,`` -> [1, 2];
    ``,,`` -> []; an empty line -> [''] (one token)."""
    col = F.col(line) if isinstance(line, str) else line

    def trimmed(t):
        last = F.array_max(F.transform(t, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
        return F.when(F.size(t) == 1, t).otherwise(F.slice(t, 1, last))

    return F.element_at(F.transform(F.array(F.split(col, sep, -1)), trimmed), 1)  # split once


def filter_width(df: DataFrame, tokens: str, dims: int | Sequence[int]) -> DataFrame:
    """FLT-1 / FLT-4: keep rows whose token count is ``dims`` (or one of)."""
    widths = [dims] if isinstance(dims, int) else list(dims)
    return df.where(F.size(tokens).isin(*widths))


def parse_doubles(tokens: Column | str, strict: bool = True) -> Column:
    """PRJ-2: tokens -> ARRAY<DOUBLE>.  Strict: a bad token fails the job
    (ANSI cast).  Lenient: bad tokens become null (drop with
    ``complete``)."""
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    if strict:
        return F.transform(col, lambda t: t.cast("double"))
    return F.transform(col, lambda t: t.try_cast("double"))


def complete(arr: Column | str) -> Column:
    """True when no element of a parsed array is null."""
    col = F.col(arr) if isinstance(arr, str) else arr
    return ~F.exists(col, lambda x: x.isNull())


def split_weighted(tokens: Column | str, dims: int) -> tuple[Column, Column]:
    """PRJ-3: (coordinates, weight) from D+1 tokens ``v.. W`` or D+2 tokens
    ``key v.. W`` (the leading key is skipped)."""
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    start = F.when(F.size(col) == dims + 2, 2).otherwise(1)
    coords = F.slice(col, start, F.lit(dims))
    weight = F.element_at(col, -1)
    return coords, weight


def format_centers(features: Column | str, w: Column | str | None = None) -> Column:
    """PRJ-5: one text line per centre: coordinates then (optionally) the
    weight, separated by one space."""
    col = F.col(features) if isinstance(features, str) else features
    parts = [F.array_join(F.transform(col, lambda v: v.cast("string")), " ")]
    if w is not None:
        parts.append((F.col(w) if isinstance(w, str) else w).cast("string"))
    return F.concat_ws(" ", *parts)
