"""Streaming fold against the batch fold, and every registered query
against its DuckDB oracle on the small tables."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from fuzzmill.plans.fcm import fcm_chunked
from fuzzmill.streaming.stream_fcm import fold_batch, read_state, stream_chunks, stream_fcm, write_chunks


def test_stream_equals_chunk_fold_and_is_idempotent(spark, scratch):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "value")
    n = ev.count()
    rows = math.ceil(n / 3)
    src = f"{scratch}/src"
    for u in range(3):
        ev.where((F.col("event_id") >= u * rows) & (F.col("event_id") < (u + 1) * rows)).coalesce(
            1
        ).write.mode("append").parquet(src)
    state = f"{scratch}/state"
    res = stream_fcm(
        spark, src, ev.schema, ["value"], 3, 2.0, -1.0, 2, order_col="event_id",
        state_path=state, checkpoint=f"{scratch}/ck",
    )
    assert res.passes == 3
    ref = fcm_chunked(ev, ["value"], 3, rows, "event_id", 2.0, -1.0, 2, "first")
    assert np.allclose(res.centers, ref.centers, rtol=1e-9)
    assert np.allclose(res.weights, ref.weights, rtol=1e-9)
    # A replayed batch id is skipped: the state does not change.
    before = sorted(tuple(r["features"]) for r in read_state(spark, state).collect())
    last = spark.read.parquet(state).agg(F.max("batch")).first()[0]
    fold_batch(
        ev, last, features=["value"], k=3, m=2.0, eps=-1.0, max_iter=2,
        order_col="event_id", state_path=state,
    )
    after = sorted(tuple(r["features"]) for r in read_state(spark, state).collect())
    assert before == after


def test_chunk_folders_are_folded_in_number_order(spark, scratch):
    """Chunks of a fixed size written by all tasks, committed by a manifest;
    an interrupted fold goes on; file times do not matter."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "value").repartition(7)
    n = ev.count()
    rows = n // 5 - 1
    src, state = f"{scratch}/chunks", f"{scratch}/chunk-state"
    assert write_chunks(ev, "event_id", rows, src) == 6
    sizes = [spark.read.parquet(f"{src}/chunks/chunk={u}").count() for u in range(6)]
    assert sizes == [rows] * 5 + [n - 5 * rows]
    assert any(len([f for f in os.listdir(f"{src}/chunks/chunk={u}") if f.startswith("part")]) > 1 for u in range(6))
    os.utime(f"{src}/chunks/chunk=0", (2**31, 2**31))
    args = (spark, src, ev.schema, ["value"], 3, 2.0, -1.0, 2)
    fold_batch(
        spark.read.parquet(f"{src}/chunks/chunk=0"), 0, features=["value"], k=3, m=2.0, eps=-1.0, max_iter=2,
        order_col="event_id", state_path=state,
    )
    res = stream_chunks(*args, order_col="event_id", state_path=state)
    ref = fcm_chunked(ev, ["value"], 3, rows, "event_id", 2.0, -1.0, 2, "first")
    assert res.passes == ref.passes == 6
    assert np.allclose(res.centers, ref.centers, rtol=1e-9) and np.allclose(res.weights, ref.weights, rtol=1e-9)
    again = stream_chunks(*args, order_col="event_id", state_path=state)
    assert np.array_equal(again.centers, res.centers)
    with pytest.raises(ValueError, match="manifest"):
        stream_chunks(spark, f"{scratch}/none", *args[2:], order_col="event_id")


def _norm(v):
    if isinstance(v, float):
        return round(v, 4) + 0.0
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


import __spark_entry__ as entry  # noqa: E402

from fuzzmill.registry import ORACLES, QUERIES as _Q  # noqa: E402

_O = {name: entry.oracle_sql()[name] for name in ORACLES}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ["customer", "part", "lineitem", "orders", "events", "embeddings"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(_Q))
def test_registered_query_matches_oracle(spark, duck, name):
    df = _Q[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    if name not in _O:
        assert len(srows) > 0
        return
    res = duck.execute(_O[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, srows) == _rows(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert sorted(r["c"] for r in rows) == [0, 1, 2] and all(r["w"] > 0 for r in rows)
    assert df.columns[0] == "c"
