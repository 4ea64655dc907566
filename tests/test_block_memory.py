"""A task of the partial stage holds the coordinates of its block once."""

from __future__ import annotations

import glob
import os
import re

import numpy as np
from pyspark.sql import functions as F

from fuzzmill.functions import kernels
from fuzzmill.plans.two_level import partial_fcm

XS = ["x0", "x1", "x2", "x3"]
V = np.array([[0.1] * 4, [0.5] * 4, [0.9] * 4])


def workers():
    """Status files of this session's Python workers."""
    parent = {}
    for path in glob.glob("/proc/[0-9]*/stat"):
        try:
            parent[int(path.split("/")[2])] = int(open(path).read().rpartition(")")[2].split()[1])
        except OSError:
            pass
    for pid in parent:
        up = pid
        while up > 1 and up != os.getpid():
            up = parent.get(up, 0)
        try:
            if up == os.getpid() and "\0pyspark.daemon\0" in open(f"/proc/{pid}/cmdline").read():
                yield f"/proc/{pid}"
        except OSError:
            pass


def most_memory(run) -> int:
    """The largest bytes that a Python worker held while ``run`` ran."""
    for w in workers():
        try:
            with open(f"{w}/clear_refs", "w") as f:
                f.write("5")  # its peak starts anew
        except OSError:
            pass
    run()
    return max(int(re.search(r"VmHWM:\s+(\d+)", open(f"{w}/status").read())[1]) for w in workers()) * 1024


def rows(spark, n):
    return spark.range(n).select("id", *[F.rand(j).alias(x) for j, x in enumerate(XS)])


def held(spark, n, **how):
    df = rows(spark, n).coalesce(1)
    got = []
    most = most_memory(lambda: got.extend(partial_fcm(df, XS, V, 2.0, -1.0, 2, round_weights=False, **how).collect()))
    assert {r["n"] for r in got} == {n} and len(got) == len(V)
    return most


def test_a_keyed_block_is_held_once(spark):
    few, n = held(spark, 2_000, blocks=1), 1_500_000
    assert held(spark, n, blocks=1) - few < 1.5 * n * len(XS) * 8


def test_a_block_of_a_split_is_held_once(spark):
    few, n = held(spark, 2_000), 1_500_000
    assert held(spark, n) - few < 1.5 * n * len(XS) * 8


def test_a_block_taken_in_batches_is_the_same_block():
    """Uneven batches, steps that end inside a batch, dense and stepwise."""
    rng = np.random.default_rng(3)
    for n, rows_, weighted in ((50, 1_000, False), (50, 7, True), (200_000, 10_000_000, True), (200_000, 150_000, False)):
        X, w = rng.normal(size=(n, 4)), rng.integers(1, 5, size=n) if weighted else None
        block, lo = kernels.Block(4, rows_, weighted), 0
        while lo < n:
            hi = lo + int(rng.integers(0, n // 3))
            block.add(list(X[lo:hi].T), None if w is None else w[lo:hi])
            lo = hi
        want = kernels.local_fcm(X, None if w is None else w.astype(float), V, 2.0, 1e-6, 5)
        got = block.fcm(V, 2.0, 1e-6, 5)
        assert block.n == n and block.weight() == (n if w is None else int(w.sum()))
        assert got[2] == want[2] and all(np.allclose(a, b, rtol=1e-12, atol=1e-12) for a, b in zip(got[:2], want[:2]))
