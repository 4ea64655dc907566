"""Streaming chunk fold (ST-1): every micro-batch is one chunk of IT-3.

State = {C centres, C weights} after each batch, stored as a small
parquet table per batch id under ``state_path`` (a shared folder).  The
sink is ``foreachBatch``, which is at-least-once: a batch whose state
already exists is skipped, so a replay after a failure does not fold a
chunk twice.  Within a batch the FCM passes are ordinary distributed
jobs over the batch; the {current, previous} merge works on 2C rows.

A table becomes a stream of chunks of a fixed number of rows with
``write_chunks``: all tasks write into one folder per chunk, and a manifest
commits them.  ``stream_chunks`` folds them in the manifest's order, so the
order of chunks rests on their numbers and not on the times of files.  A
chunk starts from the centres of the one before, so chunks follow each other
whatever folds them: small ones in runs, one ``availableNow`` stream and one
task for a run of at most ``RUN_CELLS`` coordinates, of which the task holds
one chunk at a time; larger ones one by one, each by distributed passes.  The
state has the centres after every chunk either way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..functions import kernels
from ..operators.features import Points, spread, to_points, xname
from ..operators.indexing import IDX, row_index
from ..operators.passes import check_m, fuzzy_pass
from ..plans.fcm import FCMResult, drop_incomplete, iterate, resolve_init
from ..session import scratch_path


def _state_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField("c", T.IntegerType(), False),
            T.StructField("features", T.ArrayType(T.DoubleType()), False),
            T.StructField("w", T.DoubleType(), True),
            T.StructField("batch", T.LongType(), False),
            T.StructField("rows", T.LongType(), False),
            T.StructField("first_key", T.StringType(), True),
        ]
    )


def _state(spark: SparkSession, state_path: str) -> DataFrame | None:
    """The state table (C rows per folded batch, partitioned by batch), or
    None before the first batch.  Appends are atomic through Spark's
    commit protocol, so a batch is either wholly present or absent."""
    try:
        return spark.read.schema(_state_schema()).parquet(state_path)
    except AnalysisException:
        return None


def _batch_state(spark: SparkSession, state_path: str, batch_id: int) -> DataFrame | None:
    """The rows of one batch, read by the path of its partition: the cost
    does not grow with the stream.  None where the batch has none."""
    schema = T.StructType([f for f in _state_schema() if f.name != "batch"])
    try:
        return spark.read.schema(schema).parquet(f"{state_path}/batch={int(batch_id)}")
    except AnalysisException:
        return None


def _is_done(spark: SparkSession, state_path: str, batch_id: int) -> bool:
    return _batch_state(spark, state_path, batch_id) is not None


def _previous(spark: SparkSession, state_path: str, batch_id: int | None = None):
    """The latest folded batch id (below ``batch_id`` when given), by one
    aggregate - nothing that grows with the stream is collected."""
    if batch_id is not None and batch_id > 0 and _is_done(spark, state_path, batch_id - 1):
        return batch_id - 1
    if batch_id == 0:
        return None
    st = _state(spark, state_path)  # the batch before was empty: look further
    if st is None:
        return None
    if batch_id is not None:
        st = st.where(F.col("batch") < batch_id)
    return st.agg(F.max("batch")).first()[0]


def read_state(spark: SparkSession, state_path: str, batch_id: int | None = None) -> DataFrame:
    """Centres after ``batch_id`` (default: the latest batch); a read of one
    partition of the state table."""
    b = _previous(spark, state_path) if batch_id is None else batch_id
    if b is None:
        raise ValueError("no state written yet")
    st = _batch_state(spark, state_path, b)
    if st is None:
        raise ValueError(f"batch {b} has no state")
    return st.withColumn("batch", F.lit(int(b)).cast("long"))


def _centers(spark: SparkSession, state_path: str, batch_id: int) -> tuple[np.ndarray, np.ndarray]:
    st = read_state(spark, state_path, batch_id).orderBy("c").collect()
    return np.array([r["features"] for r in st], dtype=float), np.array([r["w"] for r in st], dtype=float)


def fold_batch(
    batch: DataFrame,
    batch_id: int,
    *,
    features,
    k: int,
    m: float,
    eps: float,
    max_iter: int,
    order_col: str,
    state_path: str,
    init=None,
    dims: int | None = None,
    engine: str = "auto",
):
    """Fold one micro-batch into the state (idempotent per batch id)."""
    spark = batch.sparkSession
    if _is_done(spark, state_path, batch_id):
        return
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)  # read once
    try:
        _fold(batch, batch_id, features, k, m, eps, max_iter, order_col, state_path, init, dims, engine)
    finally:
        batch.unpersist()


def _fold(batch, batch_id, features, k, m, eps, max_iter, order_col, state_path, init, dims, engine):
    spark = batch.sparkSession
    prev_id = _previous(spark, state_path, batch_id)
    n, first_key = batch.agg(F.count(F.lit(1)), F.min(order_col).cast("string")).first()
    if n == 0:
        return
    if prev_id is not None:
        V, w = _centers(spark, state_path, prev_id)
        prev = (V.copy(), w)
    else:
        V = resolve_init(batch, features, k, init if init is not None else "first",
                         order_col=order_col, dims=dims)
        prev = None
    pts = drop_incomplete(to_points(batch, features, V.shape[1]))
    pts = Points(spread(pts.df), pts.dims, False)
    pts.df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        r = iterate(lambda C_: fuzzy_pass(pts, C_, m, engine), V, eps, max_iter)
    finally:
        pts.df.unpersist()
    V, W = r.centers, r.weights
    if prev is not None:
        # {current, previous}: 2C weighted points, bounded by C.
        V, W, _, _ = kernels.local_fcm(
            np.vstack([V, prev[0]]), np.concatenate([W, prev[1]]), V, m, eps, max_iter
        )
    rows = [
        (i, [float(x) for x in V[i]], float(W[i]), int(batch_id), int(n), first_key)
        for i in range(V.shape[0])
    ]
    spark.createDataFrame(rows, _state_schema()).coalesce(1).write.mode("append").partitionBy(
        "batch"
    ).parquet(state_path)


def stream_fcm(
    spark: SparkSession,
    source_path: str,
    schema: T.StructType,
    features,
    k: int,
    m: float = 2.0,
    eps: float = 1e-3,
    max_iter: int = 100,
    *,
    order_col: str,
    state_path: str | None = None,
    checkpoint: str | None = None,
    files_per_batch: int = 1,
    init=None,
    dims: int | None = None,
    with_history: bool = False,
) -> FCMResult:
    """ST-1: fold every file (``files_per_batch`` files) arriving under
    ``source_path`` as one chunk; runs until the source is drained
    (``availableNow``) and returns the final state."""
    m = check_m(m)
    state_path = state_path or scratch_path(spark, "stream-state")
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source_path)
    )

    def sink(batch_df, batch_id):
        fold_batch(
            batch_df, batch_id, features=features, k=k, m=m, eps=eps, max_iter=max_iter,
            order_col=order_col, state_path=state_path, init=init, dims=dims,
        )

    q = (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    st = read_state(spark, state_path).orderBy("c").collect()
    V = np.array([r["features"] for r in st], dtype=float)
    W = np.array([r["w"] for r in st], dtype=float)
    full = _state(spark, state_path)
    res = FCMResult(V, W, int(full.select("batch").distinct().count()), float("nan"))
    if with_history:
        # One row per batch: only on request (tests, short runs).
        res.history = [
            r["first_key"] for r in full.where(F.col("c") == 0).orderBy("batch").collect()
        ]
    return res


# ---- chunks of a table --------------------------------------------------------

_MANIFEST = "rows BIGINT, rows_per_chunk BIGINT, chunks BIGINT"


def write_chunks(df: DataFrame, order_col, rows_per_chunk: int, path: str) -> int:
    """Cut ``df`` in ``order_col`` order into chunks of ``rows_per_chunk``
    rows (the last may be shorter): one folder each under ``path``/chunks,
    written by the tasks that hold its rows.  Returns the number of chunks.
    The manifest is written last; without it the chunks do not count."""
    rows_per_chunk = int(rows_per_chunk)
    if rows_per_chunk < 1:
        raise ValueError("rows_per_chunk must be >= 1")
    spark = df.sparkSession
    indexed = row_index(df, order_col)
    chunk = F.floor(F.col(IDX) / F.lit(rows_per_chunk)).cast("long").alias("chunk")
    indexed.numbered().select(*df.columns, chunk).write.partitionBy("chunk").parquet(f"{path}/chunks")
    chunks = -(-indexed.n // rows_per_chunk)
    manifest = spark.createDataFrame([(indexed.n, rows_per_chunk, chunks)], _MANIFEST)
    manifest.coalesce(1).write.parquet(f"{path}/manifest")
    return chunks


def read_manifest(spark: SparkSession, path: str) -> dict:
    try:
        row = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").first()
    except AnalysisException:
        row = None
    if row is None:
        raise ValueError(f"the chunks under {path} are not complete: there is no manifest")
    return row.asDict()


#: Chunks of up to this many coordinates are folded in runs of up to
#: RUN_CELLS coordinates.
CHUNK_CELLS, RUN_CELLS = 1_000_000, 4_000_000


def _run_chunks(features, dims: int | None, schema: T.StructType, rows_per_chunk: int) -> int:
    """Chunks of a run; 1 where a chunk is too large for a task, or its
    width is not known."""
    if isinstance(features, str):
        width = dims if schema[features].dataType.typeName() == "array" else 1
    else:
        width = len(features)
    cells = rows_per_chunk * width if width else RUN_CELLS
    return max(1, RUN_CELLS // cells) if cells <= CHUNK_CELLS else 1


def _open_chunks(spark: SparkSession, state_path: str, chunks: int) -> tuple[int, int]:
    """The first chunk without a state, and the next one that has a state
    (``chunks`` where there is none)."""
    st = _state(spark, state_path)
    if st is None:
        return 0, chunks
    done = st.select("batch").distinct()
    after = done.select((F.col("batch") + 1).alias("batch")).unionByName(spark.range(1).select(F.col("id").alias("batch")))
    lo = after.join(done, "batch", "left_anti").agg(F.min("batch")).first()[0]
    hi = done.where(F.col("batch") > lo).agg(F.min("batch")).first()[0]
    return lo, chunks if hi is None else min(hi, chunks)


def _fold_run(batch, lo, hi, features, k, m, eps, max_iter, order_col, state_path, init, dims):
    """Fold the chunks lo .. hi - 1 of ``batch`` (its column ``chunk``) one
    after the other inside one task, and append the state after each."""
    spark = batch.sparkSession
    prev_id = _previous(spark, state_path, lo)
    if prev_id is not None:
        V, w = _centers(spark, state_path, prev_id)
        start = kernels.Fold(V, m, eps, max_iter).at(V, w, 1)
    else:
        V = resolve_init(batch.where(F.col("chunk") == lo), features, k, init if init is not None else "first",
                         order_col=order_col, dims=dims)
        start = kernels.Fold(V, m, eps, max_iter)
    C, D = V.shape
    names = [xname(j) for j in range(D)]

    def run(batches):
        fold, at, held = start.at(start.V, start.W, start.chunks), lo, []

        def close():
            nonlocal at, held
            if not held:
                raise ValueError("the point table is empty")
            fold.chunk(np.vstack(held))
            out = pa.RecordBatch.from_pydict({
                "c": pa.array(range(C), pa.int32()), "features": pa.array([list(map(float, r)) for r in fold.V], pa.list_(pa.float64())),
                "w": pa.array(fold.W.astype(float), pa.float64()), "batch": pa.array([at] * C, pa.int64()),
            })
            at, held = at + 1, []
            return out

        for rb in batches:
            own = rb.column("chunk").to_numpy()
            X = np.column_stack([rb.column(x).to_numpy() for x in names]).astype(float, copy=False)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                while a < b and at < own[a]:
                    yield close()
                if a < b:
                    held.append(X[a:b].copy())
        while at < hi:
            yield close()

    pts = drop_incomplete(to_points(batch, features, D, keep=["chunk"])).df
    pts = pts.repartition(1).sortWithinPartitions("chunk", *names)
    folded = pts.mapInArrow(run, "c INT, features ARRAY<DOUBLE>, w DOUBLE, batch BIGINT")
    counts = batch.groupBy(F.col("chunk").alias("batch")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(order_col).cast("string").alias("first_key")
    )
    out = folded.join(counts, "batch").select(*_state_schema().names)
    out = out.repartition(spark.sparkContext.defaultParallelism, "batch")
    out.write.mode("append").partitionBy("batch").parquet(state_path)


def stream_chunks(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    features,
    k: int,
    m: float = 2.0,
    eps: float = 1e-3,
    max_iter: int = 100,
    *,
    order_col: str,
    state_path: str | None = None,
    init=None,
    dims: int | None = None,
) -> FCMResult:
    """ST-1 over chunks that ``write_chunks`` committed: one stream for each
    run of chunks, in their order.  Chunks that the state already holds are
    skipped, so an interrupted fold goes on where it stopped."""
    m = check_m(m)
    state_path = state_path or scratch_path(spark, "stream-state")
    manifest = read_manifest(spark, path)
    chunks = manifest["chunks"]
    if not chunks:
        raise ValueError("the point table is empty")
    most = _run_chunks(features, dims, schema, manifest["rows_per_chunk"])
    numbered = T.StructType([*schema.fields, T.StructField("chunk", T.LongType())])
    while True:
        lo, until = _open_chunks(spark, state_path, chunks)
        if lo >= chunks:
            break
        hi = min(lo + most, until)

        def sink(batch_df, batch_id, lo=lo, hi=hi):
            if batch_id:
                raise RuntimeError(f"the chunks from {lo} came in several batches")
            if most == 1:
                fold_batch(
                    batch_df.drop("chunk"), lo, features=features, k=k, m=m, eps=eps, max_iter=max_iter,
                    order_col=order_col, state_path=state_path, init=init, dims=dims,
                )
                return
            batch_df = batch_df.persist(StorageLevel.MEMORY_AND_DISK)  # read once
            try:
                _fold_run(batch_df, lo, hi, features, k, m, eps, max_iter, order_col, state_path, init, dims)
            finally:
                batch_df.unpersist()

        folders = f"{path}/chunks/chunk={{{','.join(map(str, range(lo, hi)))}}}"
        q = (
            spark.readStream.schema(numbered).option("basePath", f"{path}/chunks").parquet(folders)
            .writeStream.foreachBatch(sink)
            .option("checkpointLocation", scratch_path(spark, "chunk-ckpt"))
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    V, w = _centers(spark, state_path, chunks - 1)
    return FCMResult(V, w, chunks, float("nan"))
