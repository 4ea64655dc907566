"""Text forms (T1, T2, T4, T6), sources/sinks round trips and sampling."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from fuzzmill.functions.fcm_math import round_weight
from fuzzmill.functions.text import filter_width, split_weighted, tokenise
from fuzzmill.operators import sampling
from fuzzmill.operators.passes import centers_df
from fuzzmill.sources.points import (
    parse_lines,
    points_from_columns,
    read_centers,
    read_points,
    read_weighted_centers,
    write_centers,
    write_points,
)


def _toks(spark, lines, sep):
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    return [r["t"] for r in df.select(tokenise("line", sep).alias("t")).collect()]


def test_tokenise_java_split_rules(spark):
    """T2: trailing empties dropped, inner and leading kept, one token kept."""
    got = _toks(spark, ["1,2,,", ",,", "", "1,,3", ",1", "7"], ",")
    assert got == [["1", "2"], [], [""], ["1", "", "3"], ["", "1"], ["7"]]


def test_tokenise_regex_and_width(spark):
    """T1: lines from lineitem with a regex separator; width filter."""
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    line = F.concat_ws(";", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
    line = F.concat_ws(" ", line, F.col("l_suppkey").cast("string"))
    t = li.select(tokenise(line, "[ ;]").alias("tok"))
    assert t.where(F.size("tok") != 3).count() == 0
    assert filter_width(t, "tok", 3).count() == li.count()
    assert filter_width(t, "tok", [2, 4]).count() == 0


def test_parse_strict_and_lenient(spark):
    lines = spark.createDataFrame([("1 2",), ("3 x",), ("5 6",), ("7",)], "value string")
    ok = parse_lines(lines, " ", 2, strict=False).collect()
    assert [r["features"] for r in ok] == [[1.0, 2.0], [5.0, 6.0]]
    with pytest.raises(Exception):
        parse_lines(lines, " ", 2, strict=True).collect()


def test_split_weighted_both_widths(spark):
    """T6: D+1 tokens (coords, weight) and D+2 tokens (key, coords, weight)."""
    df = spark.createDataFrame([("1.5 2.5 3",), ("0\t1.5 2.5 4",)], "v string")
    t = df.select(F.split("v", r"\s+", -1).alias("t"))
    c, w = split_weighted("t", 2)
    got = t.select(c.alias("c"), w.alias("w")).collect()
    assert [(r["c"], r["w"]) for r in got] == [(["1.5", "2.5"], "3"), (["1.5", "2.5"], "4")]


def test_round_weight_half_up(spark):
    """T4: 0, 0.4, 0.5, 2.5 -> 0, 0, 1, 3."""
    df = spark.createDataFrame([(0.0,), (0.4,), (0.5,), (2.5,)], "w double")
    assert [r[0] for r in df.select(round_weight("w")).collect()] == [0.0, 0.0, 1.0, 3.0]


def test_centre_and_point_round_trips(spark, scratch):
    cen = centers_df(spark, [[1.25, -3.0], [0.1, 7.5]], [4.0, 0.5])
    write_centers(cen, f"{scratch}/w", "text", weights=True)
    back = read_weighted_centers(spark, f"{scratch}/w", 2).orderBy("c").collect()
    assert [(r["features"], r["w"]) for r in back] == [([1.25, -3.0], 4.0), ([0.1, 7.5], 0.5)]
    write_centers(cen, f"{scratch}/u", "text", weights=False)
    assert [r["features"] for r in read_centers(spark, f"{scratch}/u").orderBy("c").collect()] == [
        [1.25, -3.0], [0.1, 7.5]
    ]
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    pts = points_from_columns(o, ["o_totalprice", "o_custkey"], "o_orderkey")
    write_points(pts, f"{scratch}/p", ",")
    back = read_points(spark, f"{scratch}/p", 2, ",")
    assert back.count() == o.count()
    a = sorted(tuple(r["features"]) for r in back.collect())
    b = sorted(tuple(r["features"]) for r in pts.collect())
    assert a == b


def test_sampling(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    n = o.count()
    a = [r["o_orderkey"] for r in sampling.sample_k(o, 50, 1, "o_orderkey").collect()]
    b = [r["o_orderkey"] for r in sampling.sample_k(o.repartition(5), 50, 1, "o_orderkey").collect()]
    assert len(a) == 50 and sorted(a) == sorted(b)
    assert sampling.sample_k(o, n + 10, 1, "o_orderkey").count() == n  # fewer rows than k
    rep = sampling.sample_k_repeated(o, 20, 3, 1, "o_orderkey")
    assert rep.count() == 60
    sets = [set(r.o_orderkey for r in rep.where(F.col("rep") == i).collect()) for i in range(3)]
    assert sets[0] != sets[1] and sets[1] != sets[2] and sets[0] != sets[2]
    cf = sampling.coin_flip_sample(o, 30, "o_orderkey", 4).collect()
    keys = [r["o_orderkey"] for r in cf]
    assert keys == sorted(keys) and len(keys) == 30
    kept = o.where(sampling.coin(["o_orderkey"], 4)).count()
    assert 0.4 * n < kept < 0.6 * n
    assert [r.p_partkey for r in sampling.first_k(spark.read.parquet(f"{SF_SMALL}/part.parquet"), 3, "p_partkey").collect()] == [0, 1, 2]


def test_grid_and_sweep_sink(spark, scratch):
    """SRC-4 grids from text, IT-13 sweep on them, SNK-5 partitioned append."""
    from fuzzmill.plans.sweep import sweep, write_sweep
    from fuzzmill.sources.points import read_grid

    spark.createDataFrame([("2",), ("3",)], "value string").write.text(f"{scratch}/ks")
    spark.createDataFrame([("0.5",)], "value string").write.text(f"{scratch}/eps")
    ks = read_grid(spark, f"{scratch}/ks", "int")
    eps = read_grid(spark, f"{scratch}/eps")
    c = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    res = sweep(c, ["c_acctbal", "c_nationkey"], id_col="c_custkey", ks=ks, epsilons=eps,
                k=3, eps=0.5, sample_rows=80, max_iter=3, algos=("kmeans", "fuzzy_kmeans"))
    assert res.count() == 2 * 2 + 2
    write_sweep(res, f"{scratch}/out")
    back = spark.read.parquet(f"{scratch}/out")
    assert sorted(r.varied for r in back.select("varied").distinct().collect()) == ["centers", "epsilon"]
    assert back.count() == 6


def _java_split(s: str, sep: str):
    import re

    parts = re.split(sep, s)
    if len(parts) == 1:
        return parts
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def test_tokenise_property(spark):
    """Java split rules on generated lines (one Spark job for all)."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    lines = []

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=",1a ", max_size=8))
    def collect(s):
        lines.append(s)

    collect()
    got = _toks(spark, lines, ",")
    assert got == [_java_split(s, ",") for s in lines]


def test_chunk_of(spark):
    from fuzzmill.functions.fcm_math import chunk_of

    df = spark.range(0, 10).select(chunk_of(F.col("id"), 4).alias("c"))
    assert [r.c for r in df.collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_sample_k_prefilter_is_exact(spark, monkeypatch):
    """The hash-prefix pre-filter picks exactly the plain top-k rows."""
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    plain = sorted(r["o_orderkey"] for r in sampling.sample_k(o, 40, 9, "o_orderkey").collect())
    monkeypatch.setattr(sampling, "TOPK_STREAM_MAX_ROWS", 0)
    pre = sorted(r["o_orderkey"] for r in sampling.sample_k(o, 40, 9, "o_orderkey").collect())
    assert pre == plain and len(pre) == 40


def test_coin_flip_prefilter_is_exact(spark, monkeypatch):
    """The order-key cutoff picks exactly the plain first n kept rows."""
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    plain = [r["o_orderkey"] for r in sampling.coin_flip_sample(o, 50, "o_orderkey", 4).collect()]
    monkeypatch.setattr(sampling, "TOPK_STREAM_MAX_ROWS", 0)
    pre = [r["o_orderkey"] for r in sampling.coin_flip_sample(o, 50, "o_orderkey", 4).collect()]
    assert pre == plain and len(pre) == 50


def test_repeated_samples_share_a_scan_and_agree(spark, scratch, monkeypatch):
    """One scan for all repeats; each is the sample of its own seed, also
    where keys repeat and rows are equal."""
    df = spark.range(4000).select(F.when(F.col("id") % 50 > 0, F.col("id") % 1500).alias("id"), (F.col("id") % 3).alias("v"))
    df.repartition(6).write.parquet(f"{scratch}/t")
    df = spark.read.parquet(f"{scratch}/t")
    once = sampling.sample_k_repeated(df, 30, 4, 9, unique_id=True)
    assert once._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    monkeypatch.setattr(sampling, "MERGE_BUCKETS", 3)
    got = sampling.sample_k_repeated(df, 30, 4, 9)
    assert got.columns == ["id", "v", "rep"]
    rows = lambda d: sorted((-1 if r["id"] is None else r["id"], r["v"]) for r in d.collect())
    for r in range(4):
        assert rows(got.where(F.col("rep") == r)) == rows(sampling.sample_k(df, 30, f"9.{r}"))


def test_sample_with_repeated_ids_keys_only_near_rows(spark, monkeypatch):
    """Few rows are given keys for a small sample, and it is that of all keys:
    ids that repeat, copies of rows, more of them than are looked at, null ids."""
    rows = [(None if k % 50 == 0 else k % 900, float(k % 1300)) for k in range(4000)] + [(5, 1.0)] * 300 + [(7, None)] * 9
    df = spark.createDataFrame(rows, "id BIGINT, x DOUBLE").repartition(5)
    whole = sampling.keyed_rows(df, ["id"], [3]).selectExpr("id", "x", "__key[0] as h").orderBy("h").limit(60).collect()
    seen, keyed = [], sampling.keyed_rows
    monkeypatch.setattr(sampling, "keyed_rows", lambda d, *a: (seen.append(d.count()), keyed(d, *a))[1])
    got = sampling.sample_k(df, 60, 3, "id", ["x"], keep_key="h").collect()
    assert sorted(map(tuple, got), key=lambda r: r[2]) == [tuple(r) for r in whole]
    assert len(seen) == 1 and seen[0] < 2500


def test_sub_blocks_are_runs_in_hash_order(spark):
    """Keys of several sub-blocks, of one, a null key, copies."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from fuzzmill.plans.two_level import sub_blocks

    rows = [(None if k % 7 == 0 else "ab"[k % 2], float(k % 997)) for k in range(6000)] + [("c", 2.0)] * 50
    df = spark.createDataFrame(rows, "g STRING, __x0 DOUBLE").repartition(4)
    got = {(r["g"], r["__x0"]): (r["__sub"], r["__n"]) for r in sub_blocks(df, "g", 1, 60).collect()}
    each = df.groupBy("g", "__x0").count().withColumn("lot", sampling.hash_key(["__x0"], "block"))
    at = F.row_number().over(Window.partitionBy("g").orderBy("lot")) - 1
    want = {(r["g"], r["__x0"]): (r["s"], r["count"]) for r in each.withColumn("s", F.floor(at / 60)).collect()}
    assert got == want and max(s for s, _ in got.values()) > 10


def test_sub_blocks_rank_no_points(spark):
    """Points are neither sorted nor joined by a shuffle to be placed."""
    from fuzzmill.plans.two_level import sub_blocks

    df = spark.range(5000).selectExpr("id % 2 as g", "cast(id as double) as __x0")
    plan = sub_blocks(df, "g", 1, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_ids_that_repeat_far_from_the_sample_have_no_say(spark, scratch):
    """No id near the sample repeats: a plain top-k of the whole table, equal
    to that of all keys; one that repeats near it is not."""
    ids = spark.range(3000).withColumn("h", sampling.hash_key("id", 3)).orderBy("h")
    order = [r["id"] for r in ids.collect()]
    rows = lambda twice: spark.createDataFrame([(i, 1.0) for i in range(3000)] + [(i, 2.0) for i in twice], "id BIGINT, x DOUBLE")
    plans = []
    for i, twice in enumerate((order[-3:], order[1:4], [])):
        rows(twice).write.parquet(f"{scratch}/{i}")  # of known size
        df = spark.read.parquet(f"{scratch}/{i}")
        whole = sampling.keyed_rows(df, ["id"], [3]).selectExpr("id", "x", "__key[0] as h").orderBy("h").limit(20).collect()
        got = sampling.sample_k(df, 20, 3, "id", ["x"], keep_key="h")
        assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [tuple(r) for r in whole]
        plans.append("TakeOrderedAndProject" in got._jdf.queryExecution().executedPlan().toString())
    assert plans == [True, False, True]
