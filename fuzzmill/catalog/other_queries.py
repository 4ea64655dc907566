"""Sampling (LM-1..5), baselines (IT-9..12), sweep (IT-13) and the
streaming chunk fold (ST-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle_sql as osql
from ..operators import sampling
from ..operators.passes import centers_df
from ..plans.kmeans import assign, describe_clusters, fuzzy_kmeans, kmeans
from ..plans.sweep import sweep
from ..session import scratch_path
from ..sources.points import read_grid
from ..streaming.stream_fcm import stream_chunks, write_chunks
from .common import (
    CUST_X,
    FEW,
    M,
    NO_EPS,
    PART_X,
    PASSES,
    matrix_out,
    pts_sql,
    query,
    sample_key_sql,
    table,
    xs_of,
)


def _md5(key: str, seed) -> str:
    return f"md5(concat(CAST({key} AS VARCHAR), '-', '{seed}'))"


# ---- LM-1 .. LM-5 -------------------------------------------------------------


@query(
    "lm1_coin_flip_orders",
    lambda: (
        "SELECT o_orderkey, round(o_totalprice, 4) AS x0 FROM orders "
        f"WHERE substr({_md5('o_orderkey', 7)}, 1, 1) < '8' ORDER BY o_orderkey LIMIT 500"
    ),
)
def lm1_coin_flip_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = sampling.coin_flip_sample(o, 500, "o_orderkey", 7)
    return s.select("o_orderkey", F.round("o_totalprice", 4).alias("x0"))


@query(
    "lm2_first_k_part",
    lambda: "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_partkey LIMIT 5",
)
def lm2_first_k_part(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return sampling.first_k(p, 5, "p_partkey").select("p_partkey", "p_size", "p_retailprice")


@query(
    "lm3_sample_k_orders",
    lambda: (
        "SELECT o_orderkey, round(o_totalprice, 4) AS x0 FROM orders "
        f"ORDER BY {_md5('o_orderkey', 42)}, o_orderkey LIMIT 200"
    ),
)
def lm3_sample_k_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = sampling.sample_k(o, 200, 42, "o_orderkey")
    return s.select("o_orderkey", F.round("o_totalprice", 4).alias("x0"))


def _o_lm4():
    parts = [
        f"SELECT * FROM (SELECT CAST({r} AS INTEGER) AS rep, o_orderkey, round(o_totalprice, 4) AS x0 "
        f"FROM orders ORDER BY {_md5('o_orderkey', f'42.{r}')}, o_orderkey LIMIT 50)"
        for r in range(3)
    ]
    return "\nUNION ALL\n".join(parts)


@query("lm4_sample_k_repeated_orders", _o_lm4)
def lm4_sample_k_repeated_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = sampling.sample_k_repeated(o, 50, 3, 42, "o_orderkey")
    return s.select(F.col("rep").cast("int").alias("rep"), "o_orderkey", F.round("o_totalprice", 4).alias("x0"))


@query(
    "lm5_random_seeds_part",
    lambda: (
        "SELECT p_partkey, p_size, p_retailprice FROM part "
        f"ORDER BY {_md5('p_partkey', 11)}, p_partkey LIMIT 4"
    ),
)
def lm5_random_seeds_part(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return sampling.random_seeds(p, 4, 11, "p_partkey").select("p_partkey", "p_size", "p_retailprice")


COPY_COLS = ["quantity", "line", "discount"]


def _copies_sql(k: int, seed) -> str:
    """The k rows drawn from lineitem rows that repeat, with their key."""
    key = sample_key_sql("CAST(quantity AS VARCHAR)", COPY_COLS[1:], seed)
    return (
        f"SELECT quantity, line, discount FROM (SELECT *, {key} AS h FROM (SELECT CAST(l_quantity AS BIGINT) AS quantity, "
        f"CAST(l_linenumber AS BIGINT) AS line, CAST(round(l_discount * 100) AS BIGINT) AS discount FROM lineitem) t) s "
        f"ORDER BY h LIMIT {k}"
    )


def _copies(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_quantity").cast("bigint").alias("quantity"), F.col("l_linenumber").cast("bigint").alias("line"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("discount"),
    )


@query("lm3_sample_k_copies_lineitem", lambda: _copies_sql(300, 42))
def lm3_sample_k_copies_lineitem(spark, sf_dir):
    """A key of 50 values and rows that are equal many times over."""
    return sampling.sample_k(_copies(spark, sf_dir), 300, 42, "quantity")


def _o_lm4_copies():
    return "\nUNION ALL\n".join(f"SELECT CAST({r} AS INTEGER) AS rep, * FROM ({_copies_sql(80, f'42.{r}')})" for r in range(4))


@query("lm4_sample_k_repeated_copies_lineitem", _o_lm4_copies)
def lm4_sample_k_repeated_copies_lineitem(spark, sf_dir):
    return sampling.sample_k_repeated(_copies(spark, sf_dir), 80, 4, 42, "quantity")


# ---- IT-9 .. IT-12 on part --------------------------------------------------------

KM_K = 4
KM_SEED = 11
KM_PASSES = 5


def _o_part_random_seed(q):
    pts = q.add(pts_sql("part", PART_X, ", p_partkey"), "pts")
    seed = osql.seed_rows(q, pts, xs_of(2), KM_K, f"{_md5('p_partkey', KM_SEED)}, p_partkey")
    return pts, seed


def _o_kmeans(q, pts, cen, passes, k=KM_K):
    d = 2
    for _ in range(passes):
        dist = ", ".join(
            "(" + " + ".join(f"(p.x{j} - c.v{i}_{j}) * (p.x{j} - c.v{i}_{j})" for j in range(d)) + f") AS d{i}"
            for i in range(k)
        )
        near = "CASE " + " ".join(
            f"WHEN d{i} = least({', '.join(f'd{t}' for t in range(k))}) THEN {i}" for i in range(k - 1)
        ) + f" ELSE {k - 1} END"
        a = q.add(
            f"SELECT x0, x1, {near} AS c FROM (SELECT p.x0, p.x1, {dist} "
            f"FROM (SELECT *, 1 AS one FROM {pts}) p JOIN {cen} c ON p.one = c.one) z",
            "assign",
        )
        aggs = ", ".join(
            [f"sum(CASE WHEN c = {i} THEN x{j} END) AS s{i}_{j}" for i in range(k) for j in range(d)]
            + [f"count(CASE WHEN c = {i} THEN 1 END) AS n{i}" for i in range(k)]
        )
        s = q.add(f"SELECT {aggs}, 1 AS one FROM {a}", "ksum")
        newv = ", ".join(
            f"CASE WHEN s.n{i} > 0 THEN s.s{i}_{j} / s.n{i} ELSE c.v{i}_{j} END AS v{i}_{j}"
            for i in range(k)
            for j in range(d)
        )
        neww = ", ".join(f"s.n{i} AS w{i}" for i in range(k))
        cen = q.add(f"SELECT {newv}, {neww}, 1 AS one FROM {s} s JOIN {cen} c ON s.one = c.one", "kcen")
    return cen


def _o_it9():
    q = osql.Sql()
    pts, seed = _o_part_random_seed(q)
    cen = _o_kmeans(q, pts, seed, KM_PASSES)
    rows = [
        f"SELECT CAST({i} AS INTEGER) AS c, round(v{i}_0, 4) AS x0, round(v{i}_1, 4) AS x1, CAST(w{i} AS BIGINT) AS n FROM {cen}"
        for i in range(KM_K)
    ]
    return q.render("\nUNION ALL\n".join(rows))


def _part_kmeans(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return kmeans(p, PART_X, KM_K, NO_EPS, KM_PASSES, "random", id_col="p_partkey", seed=KM_SEED)


@query("it9_kmeans_part", _o_it9)
def it9_kmeans_part(spark, sf_dir):
    res = _part_kmeans(spark, sf_dir)
    return matrix_out(spark, res.centers, res.weights, w_name="n", w_type="BIGINT")


def _o_it10():
    q = osql.Sql()
    pts, seed = _o_part_random_seed(q)
    cen = _o_kmeans(q, pts, seed, KM_PASSES)
    k, d = KM_K, 2
    dist = ", ".join(
        "(" + " + ".join(f"(p.x{j} - c.v{i}_{j}) * (p.x{j} - c.v{i}_{j})" for j in range(d)) + f") AS d{i}"
        for i in range(k)
    )
    least = f"least({', '.join(f'd{t}' for t in range(k))})"
    near = "CASE " + " ".join(f"WHEN d{i} = {least} THEN {i}" for i in range(k - 1)) + f" ELSE {k - 1} END"
    return q.render(
        f"SELECT p_partkey AS id, CAST({near} AS INTEGER) AS c, round(sqrt({least}), 4) AS distance "
        f"FROM (SELECT p.p_partkey, {dist} FROM (SELECT *, 1 AS one FROM {pts}) p JOIN {cen} c ON p.one = c.one) z"
    )


@query("it10_assign_part", _o_it10)
def it10_assign_part(spark, sf_dir):
    res = _part_kmeans(spark, sf_dir)
    p = table(spark, sf_dir, "part")
    a = assign(p, PART_X, res.centers, "p_partkey")
    return a.select("id", "c", F.round("distance", 4).alias("distance"))


def _o_it11(extra_dims=False):
    q = osql.Sql()
    pts, seed = _o_part_random_seed(q)
    cen = osql.fcm_passes(q, pts, seed, KM_K, 2, 2.0, PASSES)
    extra = ", CAST(2 AS INTEGER) AS dims" if extra_dims else ""
    return q.render(osql.output(cen, KM_K, 2, True, extra))


def _part_fkm(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return fuzzy_kmeans(p, PART_X, KM_K, NO_EPS, PASSES, id_col="p_partkey", seed=KM_SEED)


@query("it11_fuzzy_kmeans_part", _o_it11)
def it11_fuzzy_kmeans_part(spark, sf_dir):
    res = _part_fkm(spark, sf_dir)
    return matrix_out(spark, res.centers, res.weights)


@query("it12_describe_clusters_part", lambda: _o_it11(extra_dims=True))
def it12_describe_clusters_part(spark, sf_dir):
    res = _part_fkm(spark, sf_dir)
    d = describe_clusters(centers_df(spark, res.centers, res.weights))
    return d.select(
        "c", *[F.round(F.col("features")[j], 4).alias(f"x{j}") for j in range(2)],
        F.round("w", 4).alias("w"), F.col("dims").cast("int").alias("dims"),
    )


# ---- IT-13: parameter sweep (times left out) ----------------------------------------

IT13_SAMPLES, IT13_ROWS, IT13_KS, IT13_K, IT13_SEED = 2, 500, (2, 3), 3, 3


def _o_it13_run(q, algo, s, k):
    """(last centres, the ones before, passes) of one run on sample ``s``."""
    key = _md5("c_custkey", f"{IT13_SEED}.{s}")
    rows = f"(SELECT * FROM customer ORDER BY {key}, c_custkey LIMIT {IT13_ROWS}) t"
    pts = q.add(pts_sql(rows, CUST_X, ", c_custkey"), "smp")
    seed = osql.seed_rows(q, pts, xs_of(2), k, f"{_md5('c_custkey', f'{IT13_SEED}.{s}.0')}, c_custkey")
    if algo == "kmeans":
        before = _o_kmeans(q, pts, seed, FEW - 1, k)
        return _o_kmeans(q, pts, before, 1, k), before, FEW
    if algo == "fuzzy_kmeans":
        before = osql.fcm_passes(q, pts, seed, k, 2, M, FEW - 1)
        return osql.fcm_passes(q, pts, before, k, 2, M, 1), before, FEW
    start = osql.fcm_passes(q, pts, seed, k, 2, M, FEW)
    part = osql.round_weights(q, osql.fcm_passes(q, pts, start, k, 2, M, FEW), k, 2)
    merged = osql.fcm_passes(q, osql.centers_as_points(q, [part], k, 2), start, k, 2, M, FEW, weighted=True)
    mpts = osql.centers_as_points(q, [merged], k, 2)
    before = osql.fcm_passes(q, mpts, merged, k, 2, M, FEW - 1, weighted=True)
    return osql.fcm_passes(q, mpts, before, k, 2, M, 1, weighted=True), before, 3 * FEW


def _o_it13():
    q = osql.Sql()
    out = []
    for s in range(IT13_SAMPLES):
        for k in IT13_KS:
            for algo in ("kmeans", "fuzzy_kmeans", "two_level_fcm"):
                cen, before, passes = _o_it13_run(q, algo, s, k)
                moves = [[f"a.v{i}_{j} - b.v{i}_{j}" for j in range(2)] for i in range(k)]
                if algo == "kmeans":
                    shift = ", ".join(f"sqrt(pow({x}, 2) + pow({y}, 2))" for x, y in moves)
                else:
                    shift = ", ".join(f"abs({m})" for row in moves for m in row)
                total = " + ".join(f"a.v{i}_{j}" for i in range(k) for j in range(2))
                weight = " + ".join(f"a.w{i}" for i in range(k))
                grid = [("centers", NO_EPS)] + ([("epsilon", -1.0), ("epsilon", -2.0)] if k == IT13_K else [])
                for varied, eps in grid:
                    out.append(
                        f"SELECT '{algo}' AS algo, '{varied}' AS varied, CAST({s} AS INTEGER) AS sample, CAST(0 AS INTEGER) AS repeat, "
                        f"CAST({k} AS INTEGER) AS k, CAST({eps} AS DOUBLE) AS eps, CAST({passes} AS INTEGER) AS passes, "
                        f"round(greatest({shift}), 3) AS shift, round({total}, 3) AS coordinates, round({weight}, 3) AS weight "
                        f"FROM {cen} a JOIN {before} b ON a.one = b.one"
                    )
    return q.render("\nUNION ALL\n".join(out))


@query("it13_sweep_customer", _o_it13)
def it13_sweep_customer(spark, sf_dir):
    """Fixed passes; the grids are read from text, the rows are written as
    the runs end and read back; times are left out."""
    grids = scratch_path(spark, "grids")
    for name, values in (("ks", [str(k) for k in IT13_KS]), ("eps", ["-1.0", " -2.0 ", ""])):
        spark.createDataFrame([(v,) for v in values], "value STRING").coalesce(1).write.text(f"{grids}/{name}")
    out = sweep(
        table(spark, sf_dir, "customer"), CUST_X, id_col="c_custkey", ks=read_grid(spark, f"{grids}/ks", "int"),
        epsilons=read_grid(spark, f"{grids}/eps"), k=IT13_K, eps=NO_EPS, samples=IT13_SAMPLES, sample_rows=IT13_ROWS,
        repeats=1, max_iter=FEW, seed=IT13_SEED, path=scratch_path(spark, "sweep"),
    )
    total = F.aggregate(F.flatten("centers"), F.lit(0.0), lambda a, x: a + x)
    weight = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "algo", "varied", "sample", "repeat", "k", "eps", "passes", F.round("shift", 3).alias("shift"),
        F.round(total, 3).alias("coordinates"), F.round(weight, 3).alias("weight"),
    )


# ---- ST-1: the chunk fold as a stream of micro-batches -----------------------------

ST_ROWS = 2_500
ST_CHUNKS = 8  # the SQL folds up to this many


def _o_st1():
    q = osql.Sql()
    pts = q.add(pts_sql("events", ["value"], ", event_id"), "pts")
    cen = osql.seed_first(q, pts, xs_of(1), 3, "event_id")
    idx = q.add(
        f"SELECT x0, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / {ST_ROWS}) AS BIGINT) AS chunk FROM {pts}", "idx"
    )
    for u in range(ST_CHUNKS):
        chunk = q.add(f"SELECT * FROM {idx} WHERE chunk = {u}", "chunk")
        new = osql.fcm_passes(q, chunk, cen, 3, 1, M, FEW)
        if u:
            new = osql.fcm_passes(q, osql.centers_as_points(q, [new, cen], 3, 1), new, 3, 1, M, FEW, weighted=True)
            # past the last chunk the centres stay
            names = [f"{c}{i}{t}" for i in range(3) for c, t in (("v", "_0"), ("w", ""))]
            cols = ", ".join(f"CASE WHEN e.n = 0 THEN o.{c} ELSE a.{c} END AS {c}" for c in names)
            count = f"(SELECT count(*) AS n, 1 AS one FROM {chunk})"
            new = q.add(f"SELECT {cols}, 1 AS one FROM {new} a JOIN {cen} o ON a.one = o.one JOIN {count} e ON a.one = e.one", "kept")
        cen = new
    return q.render(osql.output(cen, 3, 1))


@query("st1_stream_fcm_events", _o_st1)
def st1_stream_fcm_events(spark, sf_dir):
    """Events in chunks of ST_ROWS in event_id order, each a folder that one
    stream run folds."""
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    src = scratch_path(spark, "events-src")
    write_chunks(ev, "event_id", ST_ROWS, src)
    res = stream_chunks(spark, src, ev.schema, ["value"], 3, M, NO_EPS, FEW, order_col="event_id")
    return matrix_out(spark, res.centers, res.weights)
