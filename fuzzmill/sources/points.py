"""Sources (SRC-1 .. SRC-5) and sinks (SNK-1 .. SNK-4).

Points and centres are DataFrames:

    points   id BIGINT, features ARRAY<DOUBLE>
    centers  c INT, features ARRAY<DOUBLE>, w DOUBLE

Text is read with ``spark.read.text`` (splittable, one line per row) and
turned into typed columns with built-in functions; nothing is parsed in
Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.indexing import IDX, with_row_index
from ..functions.text import (
    DEFAULT_SEP,
    WS,
    complete,
    filter_width,
    format_centers,
    parse_doubles,
    split_weighted,
    tokenise,
)
from ..session import scratch_path


def _strict(arr):
    """Fail the job on a token that is not a number (whatever the ANSI
    setting), else pass the parsed array through."""
    return F.when(complete(arr), arr).otherwise(
        F.raise_error(F.lit("a token is not a number"))
    )


def _number(token):
    return F.coalesce(token.try_cast("double"), F.raise_error(F.lit("a token is not a number")).cast("double"))


def parse_lines(
    lines: DataFrame, sep: str = DEFAULT_SEP, dims: int | Sequence[int] = 0, strict=True,
    line_col: str = "value",
) -> DataFrame:
    """Lines of the given width(s) with their ``features``.  A line is
    split and parsed once: it generates no row or one, and later filters
    on the coordinates see the parsed array."""
    widths = [dims] if isinstance(dims, int) else list(dims)
    good = F.filter(F.array(tokenise(line_col, sep)), lambda t: F.size(t).isin(*widths))
    if strict:
        parsed = F.transform(good, lambda t: F.transform(t, _number))
    else:
        parsed = F.filter(F.transform(good, lambda t: F.transform(t, lambda x: x.try_cast("double"))), complete)
    return lines.withColumn("features", F.explode(parsed))


def count_lines(lines: DataFrame, sep: str = DEFAULT_SEP, dims: int | Sequence[int] = 0, line_col: str = "value") -> dict:
    """What a lenient read of ``lines`` keeps and drops: ``points``,
    ``wrong_width`` and ``not_numbers``."""
    widths = [dims] if isinstance(dims, int) else list(dims)
    wide = F.element_at(
        F.transform(
            F.array(tokenise(line_col, sep)),
            lambda t: F.when(~F.size(t).isin(*widths), "wrong_width")
            .when(F.exists(t, lambda x: x.try_cast("double").isNull()), "not_numbers")
            .otherwise("points"),
        ), 1,
    )
    got = {r["kind"]: r["count"] for r in lines.select(wide.alias("kind")).groupBy("kind").count().collect()}
    return {k: got.get(k, 0) for k in ("points", "wrong_width", "not_numbers")}


def read_points(
    spark: SparkSession, path: str, dims: int, sep: str = DEFAULT_SEP, strict: bool = True, with_id: bool = True
) -> DataFrame:
    """SRC-1: a directory of delimited text, D numbers per line.  Lines of
    another width are dropped; ``strict`` fails on a bad number, otherwise
    such lines are dropped too.  ``id`` is the number of the line in the
    directory (files by path), whatever the split size; it costs a count of
    lines first, which ``with_id=False`` spares."""
    lines = spark.read.text(path)
    if not with_id:
        return parse_lines(lines, sep, dims, strict).select("features")
    return parse_lines(line_ids(lines), sep, dims, strict).select("id", "features")


#: A table of one row per split is broadcast up to this many rows.
BROADCAST_MAX_SPLITS = 100_000


def line_ids(lines: DataFrame) -> DataFrame:
    """``value`` and ``id``, the line's number: lines before its split (from
    one count per split) plus its place in the split.  Lines are neither
    sorted nor shuffled; a split's lines are read in order by one task."""
    file, start, pos = POSITION
    placed = _placed(lines)
    each = placed.groupBy(file, start).agg(F.count(F.lit(1)).alias("__n"), F.min(pos).alias("__first"))
    path = scratch_path(lines.sparkSession, "splits")
    each.write.parquet(path)
    each = lines.sparkSession.read.schema(each.schema).parquet(path)
    # one row per split, not per line
    before = Window.orderBy(file, start).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if each.count() <= BROADCAST_MAX_SPLITS:
        each = F.broadcast(each)
    numbered = placed.join(each, [file, start])
    return numbered.select("value", (F.col("__before") + F.col(pos) - F.col("__first")).alias("id"))


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines plus ``c`` = 0-based line number in file order, from the
    distributed row index (no single-task window, whatever the size)."""
    return with_row_index(lines, POSITION).drop(*POSITION).withColumn("c", F.col(IDX).cast("int"))


#: Where a line stands: file, block of the file, place in the read of it.
POSITION = ["__file", "__start", "__pos"]


def _placed(lines: DataFrame) -> DataFrame:
    """Lines of a text read with their POSITION, whatever the order in
    which files are packed into splits."""
    return lines.select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__pos"),
    )


def read_centers(spark: SparkSession, path: str, sep: str = DEFAULT_SEP) -> DataFrame:
    """SRC-2: centres, one per line, coordinates separated by ``sep``; ``c``
    is the line number."""
    lines = _numbered(_placed(spark.read.text(path)).where(F.length(F.trim("value")) > 0))
    feats = _strict(parse_doubles(tokenise("value", sep), strict=False))
    return lines.select(
        "c", feats.alias("features"), F.lit(None).cast("double").alias("w")
    )


def read_weighted_centers(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """SRC-3: weighted centres; a line is split on whitespace and kept when
    it has D+1 tokens (``v.. W``) or D+2 tokens (``key v.. W``); ``c`` is
    the number of the kept line."""
    tok = _placed(spark.read.text(path)).withColumn("__tok", tokenise("value", WS))
    tok = _numbered(filter_width(tok, "__tok", [dims + 1, dims + 2]))
    coords, weight = split_weighted("__tok", dims)
    return tok.select(
        "c",
        _strict(parse_doubles(coords, strict=False)).alias("features"),
        weight.cast("double").alias("w"),
    )


def read_grid(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """SRC-4: a list of values (epsilons or centre counts), one per line."""
    return (
        spark.read.text(path)
        .where(F.length(F.trim("value")) > 0)
        .select(F.trim("value").cast(kind).alias("value"))
    )


def points_from_columns(
    df: DataFrame, cols: Sequence[str], id_col: str | None = None
) -> DataFrame:
    """SRC-5: (id, features) from numeric columns; rows with a missing
    value are dropped (a fixed-width check on typed columns)."""
    feats = F.array(*[F.col(c).cast("double") for c in cols])
    ident = F.col(id_col).cast("long") if id_col else F.monotonically_increasing_id()
    out = df.select(ident.alias("id"), feats.alias("features"))
    return out.where(complete("features"))


# ---- sinks -------------------------------------------------------------------


def write_centers(
    centers: DataFrame,
    path: str,
    fmt: str = "text",
    weights: bool = True,
    mode: str = "errorifexists",
) -> None:
    """SNK-1 / SNK-2 / SNK-3: write a centre table.  ``text`` writes one
    line per centre ordered by ``c`` (coordinates, then the weight when
    ``weights``); ``parquet`` writes the typed table."""
    if fmt == "parquet":
        cols = ["c", "features"] + (["w"] if weights else [])
        centers.select(*cols).write.mode(mode).parquet(path)
        return
    line = format_centers("features", "w" if weights else None)
    # C rows: one ordered file keeps the line number equal to c.
    centers.orderBy("c").select(line.alias("value")).coalesce(1).write.mode(mode).text(path)


def write_points(points: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """SNK-4: points as delimited text, one per line."""
    line = F.array_join(F.transform("features", lambda v: v.cast("string")), sep)
    points.select(line.alias("value")).write.mode(mode).text(path)
