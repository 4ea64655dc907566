"""Maths, pass and FCM-plan queries: FN-1..7, JN-1, AG-1..6, SET-1,
IT-2, IT-3, IT-4, IT-5, IT-6, IT-7, IT-8."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from .. import oracle_sql as osql
from ..functions.fcm_math import (
    abs_shift,
    chunk_of,
    guarded_distance,
    guarded_distance_arrays,
    guarded_sq,
    inverse_sum,
    memberships_m,
    powered,
    round_weight,
)
from ..operators.features import to_points
from ..operators.indexing import IDX, with_row_index
from ..operators.passes import (
    centers_df,
    fuzzy_pass,
    max_shift_df,
    new_centers_df,
    point_center_pairs,
    stack,
    sums_frame,
    total_weight,
)
from ..plans.fcm import fcm, fcm_chunked, resolve_init, seed_centers
from ..plans.job import run_job
from ..plans.two_level import merge_fcm, partial_fcm, polish_table, two_level_fcm
from ..session import scratch_path
from ..sources.points import read_centers, read_weighted_centers, write_centers
from .common import (
    CUST_X,
    FEW,
    LINE_ORDER,
    LINE_X,
    M,
    NO_EPS,
    PART_X,
    PASSES,
    centers_table_out,
    matrix_out,
    pts_sql,
    query,
    sample_key_sql,
    seeded_pts,
    table,
    xs_of,
)

# ---- per-point maths against the first customers (FN-1..5, FN-7, JN-1) -------


def _cust(spark, sf_dir):
    return table(spark, sf_dir, "customer")


def _seeds(spark, sf_dir, k=3):
    return resolve_init(_cust(spark, sf_dir), CUST_X, k, "first", order_col="c_custkey")


def _cust_xy():
    return [F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double")]


def _o_perpoint(select: str, k: int = 3) -> str:
    """SQL over customer joined to the one-row seed table."""
    q = osql.Sql()
    pts, seed = seeded_pts(q, "customer", CUST_X, k, "c_custkey", ", c_custkey")
    return q.render(f"SELECT {select} FROM (SELECT *, 1 AS one FROM {pts}) p JOIN {seed} c ON p.one = c.one")


def _gsq_sql(x, v):
    return f"CASE WHEN {x} - {v} = 0 THEN 1e-10 ELSE ({x} - {v}) * ({x} - {v}) END"


def _dist_sql(i, dims=2):
    return "sqrt(" + " + ".join(_gsq_sql(f"p.x{j}", f"c.v{i}_{j}") for j in range(dims)) + ")"


def _o_pairs(select, k: int = 3) -> str:
    """One row for each customer and centre; ``select(i)`` gives the columns."""
    q = osql.Sql()
    pts, seed = seeded_pts(q, "customer", CUST_X, k, "c_custkey", ", c_custkey")
    pair = f"FROM (SELECT *, 1 AS one FROM {pts}) p JOIN {seed} c ON p.one = c.one"
    return q.render("\nUNION ALL\n".join(f"SELECT p.c_custkey, CAST({i} AS INTEGER) AS c, {select(i)} {pair}" for i in range(k)))


def _pairs(spark, sf_dir, columns):
    """Every customer with every centre; ``columns(i, v)`` names the values."""
    V = _seeds(spark, sf_dir)
    each = [F.struct(*(c.alias(n) for n, c in columns([float(x) for x in v]).items())) for v in V]
    t = _cust(spark, sf_dir).select("c_custkey", F.posexplode(F.array(*each)).alias("c", "at"))
    return t.select("c_custkey", F.col("c").cast("int").alias("c"), "at.*")


@query(
    "fn1_guarded_sq_customer",
    lambda: _o_pairs(lambda i: f"round({_gsq_sql('p.x0', f'c.v{i}_0')}, 4) AS g0, round({_gsq_sql('p.x1', f'c.v{i}_1')}, 10) AS g1"),
)
def fn1_guarded_sq_customer(spark, sf_dir):
    x = _cust_xy()
    return _pairs(spark, sf_dir, lambda v: {"g0": F.round(guarded_sq(x[0], v[0]), 4), "g1": F.round(guarded_sq(x[1], v[1]), 10)})


@query(
    "fn2_guarded_distance_customer",
    lambda: _o_pairs(lambda i: f"round({_dist_sql(i)}, 4) AS d, round({_dist_sql(i)}, 4) AS d_arr"),
)
def fn2_guarded_distance_customer(spark, sf_dir):
    x = _cust_xy()
    return _pairs(
        spark, sf_dir,
        lambda v: {
            "d": F.round(guarded_distance(x, v), 4),
            "d_arr": F.round(guarded_distance_arrays(F.array(*x), F.array(*map(F.lit, v))), 4),
        },
    )


@query(
    "fn3_powered_customer",
    lambda: _o_pairs(lambda i: f"round(pow({_dist_sql(i)}, {2.0 / (2.5 - 1.0)!r}), 4) AS p"),
)
def fn3_powered_customer(spark, sf_dir):
    return _pairs(spark, sf_dir, lambda v: {"p": F.round(powered(guarded_distance(_cust_xy(), v), 2.5), 4)})


def _o_fn4():
    n = [f"pow({_dist_sql(i)}, {2.0 / (M - 1.0)!r})" for i in range(3)]
    return _o_perpoint("p.c_custkey, round((" + " + ".join(f"1.0 / {x}" for x in n) + ") * 1e9, 4) AS s_e9")


@query("fn4_inverse_sum_customer", _o_fn4)
def fn4_inverse_sum_customer(spark, sf_dir):
    V = _seeds(spark, sf_dir)
    ns = [powered(guarded_distance(_cust_xy(), V[i]), M) for i in range(3)]
    return _cust(spark, sf_dir).select(
        "c_custkey", F.round(inverse_sum(ns) * F.lit(1e9), 4).alias("s_e9")
    )


def _o_fn5():
    n = [f"pow({_dist_sql(i)}, {2.0 / (M - 1.0)!r})" for i in range(3)]
    s = "(" + " + ".join(f"1.0 / {x}" for x in n) + ")"
    rows = [
        f"SELECT p.c_custkey, CAST({i} AS INTEGER) AS c, round(pow({s} * {n[i]}, {-M!r}), 6) AS um "
        f"FROM (SELECT *, 1 AS one FROM {{pts}}) p JOIN {{seed}} c ON p.one = c.one"
        for i in range(3)
    ]
    q = osql.Sql()
    pts, seed = seeded_pts(q, "customer", CUST_X, 3, "c_custkey", ", c_custkey")
    return q.render("\nUNION ALL\n".join(r.format(pts=pts, seed=seed) for r in rows))


@query("fn5_membership_customer", _o_fn5)
def fn5_membership_customer(spark, sf_dir):
    """FN-5 (and JN-2: S_k re-attached per pair, computed in line)."""
    V = _seeds(spark, sf_dir)
    ums = memberships_m(_cust_xy(), V, M)
    t = _cust(spark, sf_dir).select("c_custkey", F.posexplode(F.array(*ums)).alias("c", "um"))
    return t.select("c_custkey", F.col("c").cast("int").alias("c"), F.round("um", 6).alias("um"))


@query(
    "fn6_round_weight_lineitem",
    lambda: "SELECT l_quantity, floor(l_quantity / 2 + 0.5) AS r FROM lineitem",
)
def fn6_round_weight_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_quantity", round_weight(F.col("l_quantity") / 2).alias("r"))


@query(
    "fn7_abs_shift_customer",
    lambda: _o_pairs(lambda i: f"round(abs(p.x0 - c.v{i}_0), 4) AS a0, round(abs(p.x1 - c.v{i}_1), 4) AS a1"),
)
def fn7_abs_shift_customer(spark, sf_dir):
    x = _cust_xy()
    return _pairs(spark, sf_dir, lambda v: {"a0": F.round(abs_shift(x[0], v[0]), 4), "a1": F.round(abs_shift(x[1], v[1]), 4)})


def _o_jn1():
    rows = [
        f"SELECT p.c_custkey, CAST({i} AS INTEGER) AS c, round({_dist_sql(i)}, 4) AS d "
        "FROM (SELECT *, 1 AS one FROM {pts}) p JOIN {seed} c ON p.one = c.one"
        for i in range(3)
    ]
    q = osql.Sql()
    pts, seed = seeded_pts(q, "customer", CUST_X, 3, "c_custkey", ", c_custkey")
    return q.render("\nUNION ALL\n".join(r.format(pts=pts, seed=seed) for r in rows))


@query("jn1_point_center_pairs_customer", _o_jn1)
def jn1_point_center_pairs_customer(spark, sf_dir):
    pts = to_points(_cust(spark, sf_dir), CUST_X, keep=["c_custkey"])
    t = point_center_pairs(pts, _seeds(spark, sf_dir), ["c_custkey"])
    return t.select("c_custkey", "c", F.round("d", 4).alias("d"))


# ---- one pass and its pieces (AG-1..6, SET-1) ---------------------------------------


def _pass_rows(frame, k, dims):
    """Unpivot a one-row sums frame into (c, s0.., w)."""
    structs = [
        F.struct(
            F.lit(i).cast("int").alias("c"),
            F.array(*[F.col(f"s{i}_{j}") for j in range(dims)]).alias("s"),
            F.col(f"w{i}").alias("w"),
        )
        for i in range(k)
    ]
    return frame.select(F.inline(F.array(*structs)))


def _o_ag1():
    q = osql.Sql()
    pts, seed = seeded_pts(q, "customer", CUST_X, 3, "c_custkey", ", c_custkey")
    osql.fcm_pass(q, pts, seed, 3, 2, M, False)
    return q.render(osql.output_sums(q.last_sums, 3, 2))


@query("ag1_fuzzy_sums_customer", _o_ag1)
def ag1_fuzzy_sums_customer(spark, sf_dir):
    V = _seeds(spark, sf_dir)
    pts = to_points(_cust(spark, sf_dir), CUST_X)
    rows = _pass_rows(sums_frame(pts, V, M), 3, 2)
    return rows.select(
        "c", *[F.round(F.col("s")[j], 4).alias(f"s{j}") for j in range(2)], F.round("w", 4).alias("w")
    )


def _line_seed_order():
    return ", ".join(LINE_ORDER)


AG2_X = ["l_extendedprice", "l_discount"]


def _o_ag2():
    q = osql.Sql()
    pts = q.add(pts_sql("lineitem", AG2_X, ", l_quantity AS w, " + _line_seed_order()), "pts")
    seed = osql.seed_first(q, pts, xs_of(2), 3, _line_seed_order())
    osql.fcm_pass(q, pts, seed, 3, 2, M, True)
    sums = q.last_sums
    rows = [
        f"SELECT CAST({i} AS INTEGER) AS c, round(s{i}_0, 1) AS s0, round(s{i}_1, 4) AS s1, round(sw{i}, 4) AS w FROM {sums}"
        for i in range(3)
    ]
    return q.render("\nUNION ALL\n".join(rows))


@query("ag2_weighted_sums_lineitem", _o_ag2)
def ag2_weighted_sums_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    V = resolve_init(li, AG2_X, 3, "first", order_col=LINE_ORDER)
    pts = to_points(li, AG2_X, weight="l_quantity")
    rows = _pass_rows(sums_frame(pts, V, M), 3, 2)
    # s0 is ~1e10: one decimal keeps 11 significant digits, within what two
    # engines summing in different orders agree on.
    return rows.select(
        "c", F.round(F.col("s")[0], 1).alias("s0"), F.round(F.col("s")[1], 4).alias("s1"),
        F.round("w", 4).alias("w"),
    )


def _cust_passes(spark, sf_dir, passes):
    return fcm(_cust(spark, sf_dir), CUST_X, 3, M, NO_EPS, passes, "first", order_col="c_custkey")


def _o_cust_chain(passes_list):
    q = osql.Sql()
    pts, seed = seeded_pts(q, "customer", CUST_X, 3, "c_custkey", ", c_custkey")
    cens = [seed]
    cen = seed
    for _ in range(max(passes_list)):
        cen = osql.fcm_pass(q, pts, cen, 3, 2, M, False)
        cens.append(cen)
    return q, cens


def _o_ag3():
    q, cens = _o_cust_chain([2])
    stacked = osql.centers_as_points(q, [cens[2], cens[1]], 3, 2)
    cen = osql.fcm_pass(q, stacked, cens[2], 3, 2, M, True)
    return q.render(osql.output(cen, 3, 2))


@query("ag3_stacked_sums_customer", _o_ag3)
def ag3_stacked_sums_customer(spark, sf_dir):
    """AG-3: a weighted pass over the 2C points {current, previous}."""
    prev = _cust_passes(spark, sf_dir, 1)
    cur = _cust_passes(spark, sf_dir, 2)
    pts_df = stack(centers_df(spark, cur.centers, cur.weights), centers_df(spark, prev.centers, prev.weights), 3)
    pts = to_points(pts_df, "features", 2, weight="w")
    r = fuzzy_pass(pts, cur.centers, M)
    new = np.where(r.weights[:, None] != 0, r.sums / np.where(r.weights == 0, 1, r.weights)[:, None], cur.centers)
    return matrix_out(spark, new, r.weights)


def _o_ag4():
    q, cens = _o_cust_chain([1])
    return q.render(osql.output(cens[1], 3, 2))


@query("ag4_new_centers_customer", _o_ag4)
def ag4_new_centers_customer(spark, sf_dir):
    V = _seeds(spark, sf_dir)
    pts = to_points(_cust(spark, sf_dir), CUST_X)
    sums = _pass_rows(sums_frame(pts, V, M), 3, 2)
    new = new_centers_df(sums, centers_df(spark, V))
    return new.select(
        "c", *[F.round(F.col("features")[j], 4).alias(f"x{j}") for j in range(2)], F.round("w", 4).alias("w")
    )


def _o_ag5():
    q, cens = _o_cust_chain([1])
    a, b = cens[0], cens[1]
    diffs = ", ".join(f"abs(a.v{i}_{j} - b.v{i}_{j})" for i in range(3) for j in range(2))
    return q.render(f"SELECT round(greatest({diffs}), 4) AS shift FROM {a} a JOIN {b} b ON a.one = b.one")


@query("ag5_max_shift_customer", _o_ag5)
def ag5_max_shift_customer(spark, sf_dir):
    V = _seeds(spark, sf_dir)
    pts = to_points(_cust(spark, sf_dir), CUST_X)
    old = centers_df(spark, V)
    new = new_centers_df(_pass_rows(sums_frame(pts, V, M), 3, 2), old)
    return max_shift_df(old, new).select(F.round("shift", 4).alias("shift"))


def _o_ag6():
    q, cens = _o_cust_chain([PASSES])
    c = cens[PASSES]
    return q.render(f"SELECT round(w0 + w1 + w2, 4) AS total_w FROM {c}")


@query("ag6_total_weight_customer", _o_ag6)
def ag6_total_weight_customer(spark, sf_dir):
    res = _cust_passes(spark, sf_dir, PASSES)
    return total_weight(centers_df(spark, res.centers, res.weights)).select(
        F.round("total_w", 4).alias("total_w")
    )


def _o_set1():
    q, cens = _o_cust_chain([2])
    rows = []
    for off, cen in ((0, cens[2]), (3, cens[1])):
        for i in range(3):
            rows.append(
                f"SELECT CAST({off + i} AS INTEGER) AS c, round(v{i}_0, 4) AS x0, round(v{i}_1, 4) AS x1, round(w{i}, 4) AS w FROM {cen}"
            )
    return q.render("\nUNION ALL\n".join(rows))


@query("set1_stack_customer", _o_set1)
def set1_stack_customer(spark, sf_dir):
    prev = _cust_passes(spark, sf_dir, 1)
    cur = _cust_passes(spark, sf_dir, 2)
    st = stack(centers_df(spark, cur.centers, cur.weights), centers_df(spark, prev.centers, prev.weights), 3)
    return st.select(
        "c", *[F.round(F.col("features")[j], 4).alias(f"x{j}") for j in range(2)], F.round("w", 4).alias("w")
    )


# ---- IT-2: exact FCM over whole tables ------------------------------------------------


def _o_it2(tbl, cols, k, order, extra, passes=PASSES, m=M):
    q = osql.Sql()
    pts = q.add(pts_sql(tbl, cols, extra), "pts")
    seed = osql.seed_first(q, pts, xs_of(len(cols)), k, order)
    cen = osql.fcm_passes(q, pts, seed, k, len(cols), m, passes)
    return q.render(osql.output(cen, k, len(cols)))


@query("it2_fcm_customer", lambda: _o_it2("customer", CUST_X, 3, "c_custkey", ", c_custkey"))
def it2_fcm_customer(spark, sf_dir):
    res = _cust_passes(spark, sf_dir, PASSES)
    return matrix_out(spark, res.centers, res.weights)


@query("it2_fcm_part", lambda: _o_it2("part", PART_X, 4, "p_partkey", ", p_partkey"))
def it2_fcm_part(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    res = fcm(p, PART_X, 4, M, NO_EPS, PASSES, "first", order_col="p_partkey")
    return matrix_out(spark, res.centers, res.weights)


@query(
    "it2_fcm_lineitem",
    lambda: _o_it2("lineitem", LINE_X, 3, _line_seed_order(), ", " + _line_seed_order(), passes=FEW),
)
def it2_fcm_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    res = fcm(li, LINE_X, 3, M, NO_EPS, FEW, "first", order_col=LINE_ORDER)
    return matrix_out(spark, res.centers, res.weights)


EMB_D = 64
EMB_K = 10
EMB_M = 1.5


def _o_it2_emb():
    """Long form: (pid, j, x) points and (i, j, v, w) centres, so the SQL
    stays small whatever C x D is."""
    q = osql.Sql()
    pts = q.add(
        "SELECT vec_id AS pid, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS j, "
        "CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings",
        "lpts",
    )
    cen = osql.seed_long(q, pts, EMB_K)
    for _ in range(FEW):
        cen = osql.fcm_pass_long(q, pts, cen, EMB_M)
    return q.render(osql.output_long(cen, EMB_D))


@query("it2_fcm_embeddings", _o_it2_emb)
def it2_fcm_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    res = fcm(e, "embedding", EMB_K, EMB_M, NO_EPS, FEW, "first", order_col="vec_id", dims=EMB_D)
    return matrix_out(spark, res.centers, res.weights)


# ---- IT-3: chunk fold ---------------------------------------------------------------------

N_CHUNKS = 4


def _chunk_rows(n: int, chunks: int = N_CHUNKS) -> int:
    return max(1, math.ceil(n / chunks))


def _o_it3():
    q = osql.Sql()
    pts = q.add(
        pts_sql("customer", CUST_X, ", c_custkey"), "pts"
    )
    seed = osql.seed_first(q, pts, xs_of(2), 3, "c_custkey")
    idx = q.add(
        f"SELECT x0, x1, CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / "
        f"ceil(count(*) OVER () / {N_CHUNKS}.0)) AS BIGINT) AS chunk FROM {pts}",
        "idx",
    )
    cen = osql.fold(q, idx, seed, 3, 2, M, FEW, N_CHUNKS)
    return q.render(osql.output(cen, 3, 2))


def _it3(spark, sf_dir, mode):
    c = _cust(spark, sf_dir)
    rows = _chunk_rows(c.count())
    res = fcm_chunked(c, CUST_X, 3, rows, "c_custkey", M, NO_EPS, FEW, "first", mode=mode)
    return matrix_out(spark, res.centers, res.weights)


@query("it3_fcm_chunked_customer", _o_it3)
def it3_fcm_chunked_customer(spark, sf_dir):
    return _it3(spark, sf_dir, "local")


@query("it3_fcm_chunked_customer_distributed", _o_it3)
def it3_fcm_chunked_customer_distributed(spark, sf_dir):
    return _it3(spark, sf_dir, "distributed")


def _o_it3_ties():
    q = osql.Sql()
    pts = q.add(pts_sql("lineitem", LINE_X, ", l_orderkey"), "pts")
    order = "l_orderkey, x0, x1, x2, x3"
    seed = osql.seed_first(q, pts, xs_of(4), 3, order)
    idx = q.add(
        f"SELECT x0, x1, x2, x3, CAST(floor((row_number() OVER (ORDER BY {order}) - 1) / "
        f"ceil(count(*) OVER () / {N_CHUNKS}.0)) AS BIGINT) AS chunk FROM {pts}",
        "idx",
    )
    return q.render(osql.output(osql.fold(q, idx, seed, 3, 4, M, FEW, N_CHUNKS), 3, 4))


@query("it3_fcm_chunked_lineitem", _o_it3_ties)
def it3_fcm_chunked_lineitem(spark, sf_dir):
    """Order keys that tie: rows follow their coordinates."""
    li = table(spark, sf_dir, "lineitem")
    rows = _chunk_rows(li.count())
    res = fcm_chunked(li, LINE_X, 3, rows, "l_orderkey", M, NO_EPS, FEW, "first")
    return matrix_out(spark, res.centers, res.weights)


@query(
    "fn8_chunk_of_customer",
    lambda: "SELECT CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 64) AS BIGINT) AS chunk, c_custkey FROM customer",
)
def fn8_chunk_of_customer(spark, sf_dir):
    indexed = with_row_index(_cust(spark, sf_dir).select("c_custkey"), "c_custkey")
    return indexed.select(chunk_of(IDX, 64).alias("chunk"), "c_custkey")


# ---- IT-4 .. IT-6: partial per block, merge, polish ---------------------------------------

BLOCK = "c_nationkey"


def _o_partials(q):
    pts = q.add(pts_sql("customer", CUST_X, ", c_custkey, CAST(c_nationkey AS BIGINT) AS blk"), "pts")
    seed = osql.seed_first(q, pts, xs_of(2), 3, "c_custkey")
    seed_b = q.add(
        f"SELECT s.*, b.blk FROM {seed} s JOIN (SELECT DISTINCT blk, 1 AS one FROM {pts}) b ON s.one = b.one",
        "seedb",
    )
    cen = osql.fcm_passes(q, pts, seed_b, 3, 2, M, FEW, block="blk")
    cen = osql.round_weights(q, cen, 3, 2, block="blk")
    return seed, cen


def _o_it4():
    q = osql.Sql()
    _, cen = _o_partials(q)
    rows = [
        f"SELECT blk AS block, CAST({i} AS INTEGER) AS c, round(v{i}_0, 4) AS x0, round(v{i}_1, 4) AS x1, round(w{i}, 4) AS w FROM {cen}"
        for i in range(3)
    ]
    return q.render("\nUNION ALL\n".join(rows))


def _partials(spark, sf_dir):
    c = _cust(spark, sf_dir)
    V = _seeds(spark, sf_dir)
    parts = partial_fcm(c, CUST_X, V, M, NO_EPS, FEW, block_col=BLOCK)
    return V, parts


@query("it4_partial_fcm_customer", _o_it4)
def it4_partial_fcm_customer(spark, sf_dir):
    _, parts = _partials(spark, sf_dir)
    return parts.select(
        "block", "c", *[F.round(F.col("features")[j], 4).alias(f"x{j}") for j in range(2)],
        F.round("w", 4).alias("w"),
    )


def _o_merge(q):
    seed, cen = _o_partials(q)
    ppts = osql.centers_as_points(q, [cen], 3, 2, block="blk")
    return osql.fcm_passes(q, ppts, seed, 3, 2, M, FEW, weighted=True)


def _o_it5():
    q = osql.Sql()
    merged = _o_merge(q)
    return q.render(osql.output(merged, 3, 2))


@query("it5_merge_fcm_customer", _o_it5)
def it5_merge_fcm_customer(spark, sf_dir):
    V, parts = _partials(spark, sf_dir)
    res = merge_fcm(parts, V, M, NO_EPS, FEW)
    return matrix_out(spark, res.centers, res.weights)


@query("it5_merge_fcm_distributed_customer", _o_it5)
def it5_merge_fcm_distributed_customer(spark, sf_dir):
    V, parts = _partials(spark, sf_dir)
    res = merge_fcm(parts, V, M, NO_EPS, FEW, mode="distributed")
    return matrix_out(spark, res.centers, res.weights)


def _o_it6():
    q = osql.Sql()
    merged = _o_merge(q)
    mpts = osql.centers_as_points(q, [merged], 3, 2)
    final = osql.fcm_passes(q, mpts, merged, 3, 2, M, FEW, weighted=True)
    return q.render(osql.output(final, 3, 2))


@query("it6_polish_customer", _o_it6)
def it6_polish_customer(spark, sf_dir):
    """The merged centres as a written table, polished as one."""
    V, parts = _partials(spark, sf_dir)
    path = scratch_path(spark, "merged")
    write_centers(merge_fcm(parts, V, M, NO_EPS, FEW).to_df(spark), path, "parquet")
    return centers_table_out(polish_table(spark.read.parquet(path), M, NO_EPS, FEW), 2)


# ---- IT-8 and IT-7: seeding from a coin-flip sample, then the whole two-level plan ----------

SAMPLE_SEED = 5
SAMPLE_WHOLE = 60
SAMPLE_CHUNKED = 12


def _o_sample(q, n):
    """LM-3 over the whole table, in hash order."""
    h = f"md5(concat(CAST(c_custkey AS VARCHAR), '-', '{SAMPLE_SEED}'))"
    return q.add(
        pts_sql("customer", CUST_X, f", c_custkey, {h} AS h") + f" ORDER BY h, c_custkey LIMIT {n}",
        "sample",
    )


def _o_it8_whole():
    q = osql.Sql()
    s = _o_sample(q, SAMPLE_WHOLE)
    seed = osql.seed_first(q, s, xs_of(2), 3, "h")
    cen = osql.fcm_passes(q, s, seed, 3, 2, M, PASSES)
    return q.render(osql.output(cen, 3, 2))


def _o_seed_chunked(q):
    s = _o_sample(q, SAMPLE_CHUNKED)
    seed = osql.seed_first(q, s, xs_of(2), 3, "h")
    idx = q.add(
        f"SELECT x0, x1, CAST(floor((row_number() OVER (ORDER BY h) - 1) / 3) AS BIGINT) AS chunk FROM {s}",
        "sidx",
    )
    return osql.fold(q, idx, seed, 3, 2, M, FEW, SAMPLE_CHUNKED // 3)


def _o_it8_chunked():
    q = osql.Sql()
    cen = _o_seed_chunked(q)
    return q.render(osql.output(cen, 3, 2))


@query("it8_seed_whole_customer", _o_it8_whole)
def it8_seed_whole_customer(spark, sf_dir):
    res = seed_centers(
        _cust(spark, sf_dir), CUST_X, 3, "whole", sample_rows=SAMPLE_WHOLE,
        order_col="c_custkey", seed=SAMPLE_SEED, m=M, eps=NO_EPS, max_iter=PASSES,
    )
    return matrix_out(spark, res.centers, res.weights)


@query("it8_seed_chunked_customer", _o_it8_chunked)
def it8_seed_chunked_customer(spark, sf_dir):
    res = seed_centers(
        _cust(spark, sf_dir), CUST_X, 3, "chunked", sample_rows=SAMPLE_CHUNKED,
        order_col="c_custkey", seed=SAMPLE_SEED, m=M, eps=NO_EPS, max_iter=FEW,
    )
    return matrix_out(spark, res.centers, res.weights)


def _o_it7():
    q = osql.Sql()
    seed = _o_seed_chunked(q)
    pts = q.add(pts_sql("customer", CUST_X, ", c_custkey, CAST(c_nationkey AS BIGINT) AS blk"), "pts")
    seed_b = q.add(
        f"SELECT s.*, b.blk FROM {seed} s JOIN (SELECT DISTINCT blk, 1 AS one FROM {pts}) b ON s.one = b.one",
        "seedb",
    )
    part = osql.fcm_passes(q, pts, seed_b, 3, 2, M, FEW, block="blk")
    part = osql.round_weights(q, part, 3, 2, block="blk")
    ppts = osql.centers_as_points(q, [part], 3, 2, block="blk")
    merged = osql.fcm_passes(q, ppts, seed, 3, 2, M, FEW, weighted=True)
    mpts = osql.centers_as_points(q, [merged], 3, 2)
    final = osql.fcm_passes(q, mpts, merged, 3, 2, M, FEW, weighted=True)
    return q.render(osql.output(final, 3, 2))


@query("it7_two_level_customer", _o_it7)
def it7_two_level_customer(spark, sf_dir):
    res = two_level_fcm(
        _cust(spark, sf_dir), CUST_X, 3, M, NO_EPS, FEW, order_col="c_custkey",
        sample_rows=SAMPLE_CHUNKED, seed=SAMPLE_SEED, seeding="chunked", block_col=BLOCK,
    )
    return matrix_out(spark, res.centers, res.weights)



# ---- IT-8 and IT-7 over lineitem: a key that is not unique ----------------------------------

LINE_KEY = ["l_orderkey", "l_linenumber"]


def _o_line_seeds(q):
    h = sample_key_sql("concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))", LINE_X, SAMPLE_SEED)
    s = q.add(
        pts_sql("lineitem", LINE_X, f", {h} AS h, l_orderkey, l_linenumber")
        + f" ORDER BY h, l_orderkey, l_linenumber, {', '.join(LINE_X)} LIMIT {SAMPLE_WHOLE}",
        "sample",
    )
    seed = osql.seed_first(q, s, xs_of(4), 3, "h, x0, x1, x2, x3")
    return osql.fcm_passes(q, s, seed, 3, 4, M, FEW)


def _o_it8_line():
    q = osql.Sql()
    return q.render(osql.output(_o_line_seeds(q), 3, 4))


@query("it8_seed_uniform_lineitem", _o_it8_line)
def it8_seed_uniform_lineitem(spark, sf_dir):
    res = seed_centers(
        table(spark, sf_dir, "lineitem"), LINE_X, 3, "whole", sample_rows=SAMPLE_WHOLE,
        order_col=LINE_KEY, seed=SAMPLE_SEED, m=M, eps=NO_EPS, max_iter=FEW,
    )
    return matrix_out(spark, res.centers, res.weights)


def _o_it7_line():
    q = osql.Sql()
    seed = _o_line_seeds(q)
    pts = q.add(pts_sql("lineitem", LINE_X, ", CAST(l_linenumber AS BIGINT) AS blk"), "pts")
    seed_b = q.add(
        f"SELECT s.*, b.blk FROM {seed} s JOIN (SELECT DISTINCT blk, 1 AS one FROM {pts}) b ON s.one = b.one",
        "seedb",
    )
    part = osql.fcm_passes(q, pts, seed_b, 3, 4, M, FEW, block="blk")
    ppts = osql.centers_as_points(q, [part], 3, 4, block="blk")
    merged = osql.fcm_passes(q, ppts, seed, 3, 4, M, FEW, weighted=True)
    mpts = osql.centers_as_points(q, [merged], 3, 4)
    return q.render(osql.output(osql.fcm_passes(q, mpts, merged, 3, 4, M, FEW, weighted=True), 3, 4))


@query("it7_two_level_lineitem", _o_it7_line)
def it7_two_level_lineitem(spark, sf_dir):
    """The default seeding; block weights not rounded."""
    res = two_level_fcm(
        table(spark, sf_dir, "lineitem"), LINE_X, 3, M, NO_EPS, FEW, order_col=LINE_KEY,
        sample_rows=SAMPLE_WHOLE, seed=SAMPLE_SEED, block_col="l_linenumber", round_weights=False,
    )
    return matrix_out(spark, res.centers, res.weights)


def _o_it7_given():
    q = osql.Sql()
    pts = q.add(pts_sql("customer", CUST_X, ", c_custkey, CAST(c_nationkey AS BIGINT) AS blk"), "pts")
    seed = osql.seed_first(q, pts, xs_of(2), 3, "c_custkey")
    seed_b = q.add(
        f"SELECT s.*, b.blk FROM {seed} s JOIN (SELECT DISTINCT blk, 1 AS one FROM {pts}) b ON s.one = b.one",
        "seedb",
    )
    part = osql.fcm_passes(q, pts, seed_b, 3, 2, M, FEW, block="blk")
    ppts = osql.centers_as_points(q, [part], 3, 2, block="blk")
    merged = osql.fcm_passes(q, ppts, seed, 3, 2, M, FEW, weighted=True)
    mpts = osql.centers_as_points(q, [merged], 3, 2)
    return q.render(osql.output(osql.fcm_passes(q, mpts, merged, 3, 2, M, FEW, weighted=True), 3, 2))


@query("it7_two_level_given_seeds_customer", _o_it7_given)
def it7_two_level_given_seeds_customer(spark, sf_dir):
    """Seeds written by SNK-1, read by SRC-2, used by IT-7."""
    path = scratch_path(spark, "given-seeds")
    write_centers(centers_df(spark, _seeds(spark, sf_dir)), path, "text", weights=False)
    res = two_level_fcm(
        _cust(spark, sf_dir), CUST_X, 3, M, NO_EPS, FEW, seeds=read_centers(spark, path),
        block_col=BLOCK, round_weights=False,
    )
    return matrix_out(spark, res.centers, res.weights)


# ---- IT-4 and the whole job from text over lineitem, on hash blocks -------------------------

BLOCKS = 8


def _line_points(q, where: str = ""):
    """Points with their hash block, as IT-4 deals them."""
    text = "concat_ws('|', " + ", ".join(f"CAST(CAST({c} AS DOUBLE) AS VARCHAR)" for c in LINE_X) + ")"
    lot = f"CAST(CAST('0x' || substr(md5({text} || '-block'), 1, 8) AS BIGINT) % {BLOCKS} AS BIGINT)"
    return q.add(pts_sql("lineitem", LINE_X, f", {', '.join(LINE_KEY)}, {lot} AS blk", where), "pts")


def _line_partials(q, pts, seed):
    seed_b = q.add(
        f"SELECT s.*, b.blk FROM {seed} s JOIN (SELECT DISTINCT blk, 1 AS one FROM {pts}) b ON s.one = b.one",
        "seedb",
    )
    return osql.fcm_passes(q, pts, seed_b, 3, 4, M, FEW, block="blk")


def _o_it4_blocks():
    q = osql.Sql()
    pts = _line_points(q)
    cen = _line_partials(q, pts, osql.seed_first(q, pts, xs_of(4), 3, ", ".join([*LINE_KEY, *xs_of(4)])))
    rows = [
        f"SELECT blk AS block, CAST({i} AS INTEGER) AS c, "
        + ", ".join(f"round(v{i}_{j}, 4) AS x{j}" for j in range(4)) + f", round(w{i}, 4) AS w FROM {cen}"
        for i in range(3)
    ]
    return q.render("\nUNION ALL\n".join(rows))


@query("it4_partial_fcm_blocks_lineitem", _o_it4_blocks)
def it4_partial_fcm_blocks_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    V = resolve_init(li, LINE_X, 3, "first", order_col=LINE_ORDER)
    parts = partial_fcm(li, LINE_X, V, M, NO_EPS, FEW, blocks=BLOCKS, round_weights=False)
    return parts.select(
        "block", "c", *[F.round(F.col("features")[j], 4).alias(f"x{j}") for j in range(4)],
        F.round("w", 4).alias("w"),
    )


HOT_ROWS = 16_000  # at sf0.01 one of the three flags has more rows


def _o_it4_hot():
    """A flag's different points with their copies; those of a hot flag in
    runs of HOT_ROWS by the hash of the point."""
    q = osql.Sql()
    text = "concat_ws('|', " + ", ".join(f"CAST({x} AS VARCHAR)" for x in xs_of(4)) + ")"
    pts = q.add(pts_sql("lineitem", LINE_X, f", {', '.join(LINE_KEY)}, l_returnflag AS flag"), "pts")
    seed = osql.seed_first(q, pts, xs_of(4), 3, ", ".join([*LINE_KEY, *xs_of(4)]))
    each = q.add(
        f"SELECT flag, {', '.join(xs_of(4))}, count(*) AS w, sum(count(*)) OVER (PARTITION BY flag) AS total, "
        f"row_number() OVER (PARTITION BY flag ORDER BY md5({text} || '-block'), {', '.join(xs_of(4))}) - 1 AS pos "
        f"FROM {pts} GROUP BY flag, {', '.join(xs_of(4))}", "each",
    )
    blk = q.add(
        f"SELECT {', '.join(xs_of(4))}, CAST(w AS DOUBLE) AS w, flag || '/' || "
        f"CAST(CASE WHEN total > {HOT_ROWS} THEN CAST(floor(pos / {HOT_ROWS}) AS BIGINT) ELSE 0 END AS VARCHAR) AS blk FROM {each}", "blk",
    )
    seed_b = q.add(f"SELECT s.*, b.blk FROM {seed} s JOIN (SELECT DISTINCT blk, 1 AS one FROM {blk}) b ON s.one = b.one", "seedb")
    cen = osql.fcm_passes(q, blk, seed_b, 3, 4, M, FEW, weighted=True, block="blk")
    rows = [
        f"SELECT split_part(blk, '/', 1) AS block, CAST(split_part(blk, '/', 2) AS BIGINT) AS sub, CAST({i} AS INTEGER) AS c, "
        + ", ".join(f"round(v{i}_{j}, 4) AS x{j}" for j in range(4)) + f", round(w{i}, 4) AS w FROM {cen}"
        for i in range(3)
    ]
    return q.render("\nUNION ALL\n".join(rows))


@query("it4_partial_fcm_hot_key_lineitem", _o_it4_hot)
def it4_partial_fcm_hot_key_lineitem(spark, sf_dir):
    """A text key, and a key too large for one block."""
    li = table(spark, sf_dir, "lineitem")
    V = resolve_init(li, LINE_X, 3, "first", order_col=LINE_ORDER)
    parts = partial_fcm(li, LINE_X, V, M, NO_EPS, FEW, block_col="l_returnflag", block_rows=HOT_ROWS, round_weights=False)
    return parts.select(
        "block", "sub", "c", *[F.round(F.col("features")[j], 4).alias(f"x{j}") for j in range(4)],
        F.round("w", 4).alias("w"),
    )


def _o_job():
    q = osql.Sql()
    pts = _line_points(q, "l_linenumber <> 2")
    text = "concat('[', concat_ws(', ', " + ", ".join(f"CAST({x} AS VARCHAR)" for x in xs_of(4)) + "), ']')"
    s = q.add(
        f"SELECT {', '.join(xs_of(4))}, {sample_key_sql(text, [], SAMPLE_SEED)} AS h FROM {pts} "
        f"ORDER BY h, {', '.join(xs_of(4))} LIMIT {SAMPLE_WHOLE}",
        "sample",
    )
    seed = osql.fcm_passes(q, s, osql.seed_first(q, s, xs_of(4), 3, "h, x0, x1, x2, x3"), 3, 4, M, FEW)
    ppts = osql.centers_as_points(q, [_line_partials(q, pts, seed)], 3, 4, block="blk")
    merged = osql.fcm_passes(q, ppts, seed, 3, 4, M, FEW, weighted=True)
    mpts = osql.centers_as_points(q, [merged], 3, 4)
    final = osql.fcm_passes(q, mpts, merged, 3, 4, M, FEW, weighted=True)
    return q.render(
        f"SELECT 'merged' AS file, * FROM ({osql.output(merged, 3, 4)})\nUNION ALL\n"
        f"SELECT 'final' AS file, * REPLACE (NULL AS w) FROM ({osql.output(final, 3, 4)})"
    )


@query("it7_job_from_text_lineitem", _o_job)
def it7_job_from_text_lineitem(spark, sf_dir):
    """Lines of text (every l_linenumber 2 too wide to count) through the
    whole job, and what it wrote read back."""
    li = table(spark, sf_dir, "lineitem")
    extra = F.when(F.col("l_linenumber") == 2, F.lit("0"))
    line = F.concat_ws(",", *[F.col(c).cast("double").cast("string") for c in LINE_X], extra)
    points, out = scratch_path(spark, "job-points"), scratch_path(spark, "job-out")
    li.select(line.alias("value")).write.text(points)
    run_job(
        spark, points, out, 3, 4, NO_EPS, M, ",", SAMPLE_WHOLE, FEW, seed=SAMPLE_SEED,
        blocks=BLOCKS, round_weights=False,
    )
    merged = read_weighted_centers(spark, f"{out}/merged", 4).withColumn("file", F.lit("merged"))
    final = read_centers(spark, f"{out}/final").withColumn("file", F.lit("final"))
    return merged.unionByName(final).select(
        "file", "c", *[F.round(F.col("features")[j], 4).alias(f"x{j}") for j in range(4)],
        F.round("w", 4).alias("w"),
    )
