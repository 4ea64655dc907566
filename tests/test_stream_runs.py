"""Small chunks are folded in runs: one stream for a run, the state after every chunk."""

from __future__ import annotations

import numpy as np
import pytest

from fuzzmill.streaming import stream_fcm as st

ROWS = 20


def table(spark):
    rng = np.random.default_rng(4)
    rows = [(k, None if k % 17 == 3 else float(rng.normal(k % 3, 0.3))) for k in range(7 * ROWS - 5)]
    return spark.createDataFrame(rows, "id BIGINT, x DOUBLE")


@pytest.fixture()
def points(spark):
    return table(spark)


@pytest.fixture(scope="module")
def by_chunk(spark, tmp_path_factory):
    """Centres and weights of chunks that are folded one by one."""
    state = str(tmp_path_factory.mktemp("by-chunk") / "state")
    for u in range(7):
        st.fold_batch(
            table(spark).where(f"id div {ROWS} = {u}"), u, features=["x"], k=3, m=2.0, eps=-1.0, max_iter=2,
            order_col="id", state_path=state,
        )
    return st._centers(spark, state, 6)


def _started(spark, monkeypatch):
    """The number of streams started is the number of checkpoints asked for."""
    seen = []
    path = st.scratch_path
    monkeypatch.setattr(st, "scratch_path", lambda s, name: (seen.append(name), path(s, name))[1])
    return lambda: seen.count("chunk-ckpt")


@pytest.mark.parametrize("run_cells, streams", [(10**6, 1), (3 * ROWS, 3), (ROWS, 7)])
def test_chunks_fold_in_runs(spark, scratch, monkeypatch, points, by_chunk, run_cells, streams):
    started = _started(spark, monkeypatch)
    monkeypatch.setattr(st, "RUN_CELLS", run_cells)
    src, state = f"{scratch}/src", f"{scratch}/state"
    assert st.write_chunks(points, "id", ROWS, src) == 7
    res = st.stream_chunks(spark, src, points.schema, ["x"], 3, 2.0, -1.0, 2, order_col="id", state_path=state)
    assert started() == streams
    assert np.allclose(res.centers, by_chunk[0], rtol=1e-9) and np.allclose(res.weights, by_chunk[1], rtol=1e-9)
    rows = spark.read.parquet(state).where("c = 0").orderBy("batch").collect()
    assert [(r["batch"], r["rows"], r["first_key"]) for r in rows] == [(u, ROWS if u < 6 else ROWS - 5, str(u * ROWS)) for u in range(7)]


def test_run_goes_round_chunks_that_have_a_state(spark, scratch, points):
    src, state = f"{scratch}/src", f"{scratch}/state"
    st.write_chunks(points, "id", ROWS, src)
    args = (spark, src, points.schema, ["x"], 3, 2.0, -1.0, 2)
    whole = st.stream_chunks(*args, order_col="id", state_path=state)
    kept = spark.read.parquet(state).where("batch not in (1, 2, 5)")
    kept.repartition(1).write.partitionBy("batch").parquet(f"{scratch}/part")
    assert st._open_chunks(spark, f"{scratch}/part", 7) == (1, 3)
    again = st.stream_chunks(*args, order_col="id", state_path=f"{scratch}/part")
    assert np.allclose(again.centers, whole.centers, rtol=1e-9)
    assert spark.read.parquet(f"{scratch}/part").groupBy("batch").count().where("count = 3").count() == 7


def test_large_chunks_are_folded_by_distributed_passes(spark, scratch, monkeypatch, points):
    monkeypatch.setattr(st, "CHUNK_CELLS", ROWS - 1)
    src = f"{scratch}/src"
    st.write_chunks(points, "id", ROWS, src)
    started = _started(spark, monkeypatch)
    st.stream_chunks(spark, src, points.schema, ["x"], 3, 2.0, -1.0, 2, order_col="id", state_path=f"{scratch}/state")
    assert started() == 7


def test_chunk_without_a_point_fails(spark, scratch, points):
    src = f"{scratch}/src"
    holed = points.selectExpr("id", "if(id between 60 and 79, null, x) as x")
    st.write_chunks(holed, "id", ROWS, src)
    with pytest.raises(Exception, match="the point table is empty"):
        st.stream_chunks(spark, src, points.schema, ["x"], 3, 2.0, -1.0, 2, order_col="id", state_path=f"{scratch}/state")
