"""Session helpers: a local session for tests/bench and the shared scratch
folder.

Scratch data (chunk tables, stream inputs, streaming state) lives under
the cluster's ``spark.checkpoint.dir``, which every executor can reach.
Only when it is unset *and* the master is local do we make our own
folder, as tests do; on a cluster an unset setting is an error rather
than a silent fall-back to a machine-local path.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fuzzmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, set to a fresh local one only when
    unset on a local master."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if d:
            sc.setCheckpointDir(d)
            d = sc.getCheckpointDir()
    if d:
        return d
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    d = tempfile.mkdtemp(prefix="fuzzmill-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def estimated_tasks(df: DataFrame) -> int:
    """Tasks that a scan of ``df`` takes, from the optimizer's size
    estimate: no job is run (asking an adaptive plan for its partitions
    runs its shuffles).  A source without a known size counts as large."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(spark.sparkContext.defaultParallelism, size // max(1, int(split)))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for one job's scratch table."""
    return os.path.join(checkpoint_dir(spark), f"fuzzmill-{name}-{uuid.uuid4().hex[:12]}")


def loop_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` but without adaptive
    planning: a pass is one aggregate of known size, and planned at once it
    is one job instead of one for each of its stages.  The settings of
    ``spark`` itself stay as they are; cached tables are shared."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.adaptive.enabled", "false")
    return own


@contextmanager
def loop_frame(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as seen from a ``loop_session``, for the passes of a loop."""
    name = f"fuzzmill_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        yield loop_session(df.sparkSession).table(f"global_temp.{name}")
    finally:
        df.sparkSession.catalog.dropGlobalTempView(name)
