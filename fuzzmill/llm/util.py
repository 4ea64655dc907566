"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import pickle
import sys
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows of one Arrow batch are handed on in slices of at most this many
#: text bytes (a single longer text is a slice of its own).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_store(operator: str) -> dict:
    """A dict that outlasts one task in the Python worker process, for the
    loaded models and word caches of one operator.  Workers serve the stages
    of a job one after another: when another operator asks, what the last one
    held goes, so a worker holds as much as one operator needs."""
    worker = sys.modules.setdefault("_fuzzmill_worker", types.ModuleType("_fuzzmill_worker"))
    if getattr(worker, "operator", None) != operator:
        worker.operator, worker.held = operator, {}
        gc.collect()  # a model and its cache refer to each other
        pa.default_memory_pool().release_unused()
    return worker.held


class Shipped:
    """An object broadcast to the workers and unpickled once in each; its
    classes are sent along, so workers need no install of this package."""

    KEEP = 4  # objects kept by a worker

    def __init__(self, spark: SparkSession, value, operator: str):
        self.key, self.operator = uuid.uuid4().hex, operator
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        held = worker_store(self.operator).setdefault("shipped", {})
        if self.key not in held:
            while len(held) >= self.KEEP:
                del held[next(iter(held))]
            held[self.key] = pickle.loads(self.data.value)
        return held[self.key]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that do not clash with the user's
    (compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared scratch folder and read it back: the
    lineage is cut and lost executors only cost a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice stay small."""
    for b in batches:
        if b.num_rows == 0:
            continue
        if b.column(text).nbytes <= SLICE_BYTES:
            yield b
            continue
        start = size = 0
        for i, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0).to_pylist()):
            if i > start and size + n > SLICE_BYTES:
                yield b.slice(start, i - start)
                start, size = i, 0
            size += n
        yield b.slice(start)


def fold(id_col: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (null id: null)."""
    return F.crc32(id_col.cast("string").cast("binary")) % mod


def sample_by_hash(ids: DataFrame, id_col: str, rows: int, seed: int = 7) -> DataFrame:
    """The ``rows`` rows of ``ids`` with the smallest seeded hash of their
    id: a uniform sample that is the same whatever the partitioning."""
    (h,) = fresh(ids, "_h")
    return (
        ids.withColumn(h, F.xxhash64(F.lit(seed), F.col(id_col)))
        .orderBy(h, id_col)
        .limit(rows)
        .drop(h)
    )


def keep_rows(df: DataFrame, winners: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` named by ``winners`` (id, sig = xxhash64(text),
    unique): one row for each, also where rows repeat id and text.  Ids
    are compared null-safe.  All columns of ``df`` are returned."""
    sig, wid, n = fresh(df, "_sig", "_wid", "_n")
    signed = df.withColumn(sig, F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col(wid)) & (F.col(sig) == F.col("w.sig"))
    names = stored(winners.select(F.col(id_col).alias(wid), "sig"), "winners").alias("w")
    rows = signed.join(names, same, "left_semi")
    twice = stored(df.groupBy(F.col(id_col).alias(wid)).agg(F.count("*").alias(n)).where(F.col(n) > 1).drop(n), "repeated")
    if twice.isEmpty():  # no id repeats: a winner names one row
        return rows.drop(sig)
    often = F.col(id_col).eqNullSafe(F.col(wid))
    once = rows.join(twice, often, "left_anti")
    return once.unionByName(rows.join(twice, often, "left_semi").dropDuplicates([id_col, sig])).drop(sig)
