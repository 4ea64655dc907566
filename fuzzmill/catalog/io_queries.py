"""Text, source and sink queries: PRJ-1/2/3/5, FLT-1/4, SRC-1/2/3/5,
SNK-1/2/3/4.  Text inputs are derived from whole tables with
``concat_ws``; files go to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle_sql as osql
from ..functions.text import format_centers, parse_doubles, complete, split_weighted, tokenise
from ..operators import sampling
from ..operators.passes import centers_df
from ..operators.features import to_points
from ..plans.fcm import drop_incomplete, fcm, resolve_init
from ..session import scratch_path
from ..sources.points import (
    parse_lines,
    points_from_columns,
    read_centers,
    read_points,
    read_weighted_centers,
    write_centers,
    write_points,
)
from .common import (
    CUST_X,
    M,
    NO_EPS,
    PASSES,
    centers_table_out,
    query,
    sample_key_sql,
    seeded_pts,
    table,
)

SAMPLE_SEED = 5


def _s(c):
    return F.col(c).cast("string")


# ---- PRJ-1: tokenise with empty inner and trailing tokens --------------------


def _prj1_line():
    return F.concat_ws(
        ",",
        _s("l_orderkey"),
        F.when(F.col("l_linenumber") == 2, F.lit("")).otherwise(_s("l_partkey")),
        F.when(F.col("l_linenumber") >= 3, F.lit("")).otherwise(_s("l_suppkey")),
        F.when(F.col("l_linenumber") >= 5, F.lit("")).otherwise(_s("l_linenumber")),
    )


_PRJ1_LINE_SQL = (
    "concat_ws(',', CAST(l_orderkey AS VARCHAR), "
    "CASE WHEN l_linenumber = 2 THEN '' ELSE CAST(l_partkey AS VARCHAR) END, "
    "CASE WHEN l_linenumber >= 3 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END, "
    "CASE WHEN l_linenumber >= 5 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END)"
)


def _o_prj1():
    return (
        f"WITH l AS (SELECT {_PRJ1_LINE_SQL} AS line FROM lineitem), "
        f"t AS (SELECT line, {osql.tokenise_sql('line', ',')} AS tok FROM l) "
        "SELECT line, CAST(len(tok) AS INTEGER) AS n_tokens, array_to_string(tok, ' ') AS joined FROM t"
    )


@query("prj1_tokenise_lineitem", _o_prj1)
def prj1_tokenise_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    t = li.select(_prj1_line().alias("line")).withColumn("tok", tokenise("line", ","))
    return t.select("line", F.size("tok").alias("n_tokens"), F.array_join("tok", " ").alias("joined"))


# ---- FLT-1 / FLT-4: width filters ----------------------------------------------


def _flt_line():
    return F.concat_ws(
        " ",
        _s("l_orderkey"),
        _s("l_partkey"),
        F.when(F.col("l_linenumber") >= 2, _s("l_suppkey")),
        F.when(F.col("l_linenumber") >= 4, _s("l_linenumber")),
        F.when(F.col("l_linenumber") >= 6, _s("l_partkey")),
    )


_FLT_LINE_SQL = (
    "concat_ws(' ', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), "
    "CASE WHEN l_linenumber >= 2 THEN CAST(l_suppkey AS VARCHAR) END, "
    "CASE WHEN l_linenumber >= 4 THEN CAST(l_linenumber AS VARCHAR) END, "
    "CASE WHEN l_linenumber >= 6 THEN CAST(l_partkey AS VARCHAR) END)"
)


def _o_flt(sep, widths):
    w = ", ".join(str(x) for x in widths)
    return (
        f"WITH l AS (SELECT {_FLT_LINE_SQL} AS line FROM lineitem), "
        f"t AS (SELECT line, {osql.tokenise_sql('line', sep)} AS tok FROM l) "
        f"SELECT line, CAST(len(tok) AS INTEGER) AS n_tokens FROM t WHERE len(tok) IN ({w})"
    )


@query("flt1_filter_width_lineitem", lambda: _o_flt(" ", [4]))
def flt1_filter_width_lineitem(spark, sf_dir):
    from ..functions.text import filter_width

    li = table(spark, sf_dir, "lineitem")
    t = li.select(_flt_line().alias("line")).withColumn("tok", tokenise("line", " "))
    return filter_width(t, "tok", 4).select("line", F.size("tok").alias("n_tokens"))


@query("flt4_filter_width_weighted_lineitem", lambda: _o_flt(r"\s+", [3, 4]))
def flt4_filter_width_weighted_lineitem(spark, sf_dir):
    from ..functions.text import filter_width

    li = table(spark, sf_dir, "lineitem")
    t = li.select(_flt_line().alias("line")).withColumn("tok", tokenise("line", r"\s+"))
    return filter_width(t, "tok", [3, 4]).select("line", F.size("tok").alias("n_tokens"))


@query(
    "flt2_sample_width_lineitem",
    lambda: (
        "SELECT l_orderkey, l_linenumber, x0, x1 FROM (SELECT *, "
        + sample_key_sql("concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))", ["x0", "x1"], SAMPLE_SEED)
        + " AS h FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS DOUBLE) AS x0, CAST(l_suppkey AS DOUBLE) AS x1 "
        "FROM lineitem WHERE l_linenumber <> 3) t) s ORDER BY h LIMIT 300"
    ),
)
def flt2_sample_width_lineitem(spark, sf_dir):
    """Seeding draws from lines of the right width only; line 3 of an order
    has one number too few."""
    li = table(spark, sf_dir, "lineitem")
    line = F.concat_ws(",", _s("l_partkey"), F.when(F.col("l_linenumber") != 3, _s("l_suppkey")))
    pts = parse_lines(li.select("l_orderkey", "l_linenumber", line.alias("value")), ",", 2)
    pts = pts.select("l_orderkey", "l_linenumber", F.col("features")[0].alias("x0"), F.col("features")[1].alias("x1"))
    return sampling.sample_k(pts, 300, SAMPLE_SEED, ["l_orderkey", "l_linenumber"], ["x0", "x1"])


@query(
    "flt3_drop_incomplete_orders",
    lambda: (
        "SELECT o_orderkey, round(o_totalprice, 4) AS x0, CAST(o_custkey AS DOUBLE) AS x1 FROM orders "
        "WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0"
    ),
)
def flt3_drop_incomplete_orders(spark, sf_dir):
    """Every third price and every fifth customer is missing."""
    o = table(spark, sf_dir, "orders").withColumns(
        {
            "o_totalprice": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")),
            "o_custkey": F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")),
        }
    )
    pts = drop_incomplete(to_points(o, ["o_totalprice", "o_custkey"], keep=["o_orderkey"]))
    return pts.df.select("o_orderkey", F.round("__x0", 4).alias("x0"), F.col("__x1").alias("x1"))


# ---- PRJ-2: parse, lenient ------------------------------------------------------


def _o_prj2():
    return (
        "WITH l AS (SELECT concat_ws(' ', CAST(l_orderkey AS VARCHAR), "
        "CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(l_partkey AS VARCHAR) END, "
        "CAST(l_suppkey AS VARCHAR)) AS line FROM lineitem), "
        f"t AS (SELECT {osql.tokenise_sql('line', ' ')} AS tok FROM l), "
        "p AS (SELECT TRY_CAST(tok[1] AS DOUBLE) AS x0, TRY_CAST(tok[2] AS DOUBLE) AS x1, "
        "TRY_CAST(tok[3] AS DOUBLE) AS x2 FROM t WHERE len(tok) = 3) "
        "SELECT x0, x1, x2 FROM p WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL"
    )


@query("prj2_parse_doubles_lineitem", _o_prj2)
def prj2_parse_doubles_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    line = F.concat_ws(
        " ",
        _s("l_orderkey"),
        F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(_s("l_partkey")),
        _s("l_suppkey"),
    )
    t = li.select(tokenise(line, " ").alias("tok")).where(F.size("tok") == 3)
    p = t.select(parse_doubles("tok", strict=False).alias("f")).where(complete("f"))
    return p.select(*[F.col("f")[j].alias(f"x{j}") for j in range(3)])


# ---- PRJ-3: coordinates + weight, with and without a leading key -----------------


def _o_prj3():
    return (
        "SELECT CAST(l_orderkey AS DOUBLE) AS x0, CAST(l_partkey AS DOUBLE) AS x1, "
        "CAST(l_suppkey AS DOUBLE) AS x2, CAST(l_linenumber AS DOUBLE) AS w FROM lineitem"
    )


@query("prj3_split_weighted_lineitem", _o_prj3)
def prj3_split_weighted_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    body = [_s("l_orderkey"), _s("l_partkey"), _s("l_suppkey"), _s("l_linenumber")]
    line = F.when(F.col("l_linenumber") <= 3, F.concat_ws(" ", *body)).otherwise(
        F.concat_ws("\t", F.lit("0"), F.concat_ws(" ", *body))
    )
    t = li.select(F.split(line, r"\s+", -1).alias("tok"))
    coords, weight = split_weighted("tok", 3)
    p = t.select(parse_doubles(coords).alias("f"), weight.cast("double").alias("w"))
    return p.select(*[F.col("f")[j].alias(f"x{j}") for j in range(3)], "w")


# ---- SRC-1: read a directory of delimited text ---------------------------------


def _o_src1():
    return (
        "SELECT CAST(l_orderkey AS DOUBLE) AS x0, CAST(l_partkey AS DOUBLE) AS x1, "
        "CAST(l_suppkey AS DOUBLE) AS x2, CAST(l_linenumber AS DOUBLE) AS x3 "
        "FROM lineitem WHERE l_linenumber <> 1"
    )


@query("src1_read_points_lineitem", _o_src1)
def src1_read_points_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    line = F.concat_ws(
        " ", _s("l_orderkey"), _s("l_partkey"), _s("l_suppkey"),
        F.when(F.col("l_linenumber") != 1, _s("l_linenumber")),
    )
    path = scratch_path(spark, "src1")
    li.select(line.alias("value")).write.text(path)
    pts = read_points(spark, path, 4)
    return pts.select(*[F.col("features")[j].alias(f"x{j}") for j in range(4)])


# ---- SRC-5: points from typed columns ---------------------------------------------


@query(
    "src5_points_from_columns_orders",
    lambda: "SELECT o_orderkey AS id, round(o_totalprice, 4) AS x0, CAST(o_custkey AS DOUBLE) AS x1 FROM orders",
)
def src5_points_from_columns_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = points_from_columns(o, ["o_totalprice", "o_custkey"], "o_orderkey")
    return p.select("id", F.round(F.col("features")[0], 4).alias("x0"), F.col("features")[1].alias("x1"))


# ---- seeds and FCM centres of customer, written and read back ----------------------


def _cust_seeds(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    return resolve_init(cust, CUST_X, 3, "first", order_col="c_custkey")


def _cust_fcm(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    return fcm(cust, CUST_X, 3, M, NO_EPS, PASSES, "first", order_col="c_custkey")


def _o_seeds():
    return (
        "SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS c, "
        "round(CAST(c_acctbal AS DOUBLE), 4) AS x0, round(CAST(c_nationkey AS DOUBLE), 4) AS x1 "
        "FROM customer ORDER BY c_custkey LIMIT 3"
    )


def _o_cust_fcm(with_w=True):
    q = osql.Sql()
    pts, seed = seeded_pts(q, "customer", CUST_X, 3, "c_custkey", ", c_custkey")
    cen = osql.fcm_passes(q, pts, seed, 3, 2, M, PASSES)
    return q.render(osql.output(cen, 3, 2, with_w))


@query("src2_read_centers_customer", _o_seeds)
def src2_read_centers_customer(spark, sf_dir):
    path = scratch_path(spark, "seeds")
    write_centers(centers_df(spark, _cust_seeds(spark, sf_dir)), path, "text", weights=False)
    return centers_table_out(read_centers(spark, path), 2, with_w=False)


@query("snk1_write_centers_customer", _o_seeds)
def snk1_write_centers_customer(spark, sf_dir):
    path = scratch_path(spark, "seeds-pq")
    write_centers(centers_df(spark, _cust_seeds(spark, sf_dir)), path, "parquet", weights=False)
    return centers_table_out(spark.read.parquet(path), 2, with_w=False)


@query("src3_read_weighted_centers_customer", _o_cust_fcm)
def src3_read_weighted_centers_customer(spark, sf_dir):
    res = _cust_fcm(spark, sf_dir)
    path = scratch_path(spark, "merged")
    # The merge output form: key<TAB>coordinates weight (D + 2 tokens).
    cen = centers_df(spark, res.centers, res.weights)
    cen.orderBy("c").select(
        F.concat_ws("\t", F.lit("0"), format_centers("features", "w")).alias("value")
    ).coalesce(1).write.text(path)
    return centers_table_out(read_weighted_centers(spark, path, 2), 2)


@query("snk2_write_weighted_centers_customer", _o_cust_fcm)
def snk2_write_weighted_centers_customer(spark, sf_dir):
    res = _cust_fcm(spark, sf_dir)
    path = scratch_path(spark, "weighted")
    write_centers(centers_df(spark, res.centers, res.weights), path, "text", weights=True)
    return centers_table_out(read_weighted_centers(spark, path, 2), 2)


@query("snk3_write_final_centers_customer", lambda: _o_cust_fcm(with_w=False))
def snk3_write_final_centers_customer(spark, sf_dir):
    path = scratch_path(spark, "final")
    write_centers(centers_df(spark, _cust_seeds(spark, sf_dir)), path, "text", weights=False)
    res = _cust_fcm(spark, sf_dir)
    write_centers(centers_df(spark, res.centers), path, "text", weights=False, mode="overwrite")
    return centers_table_out(read_centers(spark, path), 2, with_w=False)


# ---- PRJ-5: text form of centres ------------------------------------------------------


def _o_prj5():
    q = osql.Sql()
    pts, seed = seeded_pts(q, "customer", CUST_X, 3, "c_custkey", ", c_custkey")
    cen = osql.fcm_passes(q, pts, seed, 3, 2, M, PASSES)
    rows = [
        f"SELECT CAST({i} AS INTEGER) AS c, concat_ws(' ', CAST(round(v{i}_0, 2) AS VARCHAR), "
        f"CAST(round(v{i}_1, 2) AS VARCHAR), CAST(round(w{i}, 2) AS VARCHAR)) AS line FROM {cen}"
        for i in range(3)
    ]
    return q.render("\nUNION ALL\n".join(rows))


@query("prj5_format_centers_customer", _o_prj5)
def prj5_format_centers_customer(spark, sf_dir):
    res = _cust_fcm(spark, sf_dir)
    cen = centers_df(spark, res.centers, res.weights)
    r2 = cen.select(
        "c",
        F.transform("features", lambda v: F.round(v, 2)).alias("features"),
        F.round("w", 2).alias("w"),
    )
    return r2.select(F.col("c"), format_centers("features", "w").alias("line"))


# ---- SNK-4: a sample written as CSV and read back ---------------------------------------


def _o_snk4():
    return (
        "SELECT round(o_totalprice, 4) AS x0, CAST(o_custkey AS DOUBLE) AS x1 FROM orders "
        "ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '-', '42')), o_orderkey LIMIT 100"
    )


@query("snk4_write_points_orders", _o_snk4)
def snk4_write_points_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pts = points_from_columns(sampling.sample_k(o, 100, 42, "o_orderkey"), ["o_totalprice", "o_custkey"], "o_orderkey")
    path = scratch_path(spark, "sample-csv")
    write_points(pts, path, ",")
    back = read_points(spark, path, 2, ",")
    return back.select(F.round(F.col("features")[0], 4).alias("x0"), F.col("features")[1].alias("x1"))

