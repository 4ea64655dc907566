"""Connected components by hooking and contraction, in DataFrame joins.

Each round every node hooks to its smallest smaller neighbour, pointers
are doubled until they reach a root, and the links are rewritten between
roots; a round at least halves the nodes that still have links.  All state
is slim tables in the shared scratch folder; nothing reaches the driver
but counts.  Every join has two stored sides, so AQE can split a root or a
node that many rows share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that is not the smallest of its
    component; ``component`` is that smallest node.  Null ends and
    self-links are ignored; an empty table gives an empty result."""
    lo, hi = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    edges = stored(links.where(F.col(a) != F.col(b)).select(lo, hi).distinct(), "cc-links")
    done = None
    while not edges.isEmpty():
        hook = stored(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "cc-hook")
        while True:  # pointer doubling
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            nxt = hook.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved"))
            nxt = stored(nxt, "cc-jump")
            hook = nxt.select("node", "root")
            if nxt.where("moved").isEmpty():
                break
        edges = _rewritten(edges, hook)
        if done is None:
            done = hook
        else:
            step = hook.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            done = stored(
                done.join(step, "root", "left").select("node", F.coalesce("_up", "root").alias("root")).unionByName(hook),
                "cc-map",
            )
    if done is None:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return done.select("node", F.col("root").alias("component"))


def _rewritten(edges: DataFrame, hook: DataFrame) -> DataFrame:
    """Links between the roots of their ends, without self-links."""
    for end in ("lo", "hi"):
        to = hook.select(F.col("node").alias(end), F.col("root").alias("_to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        if end == "lo":
            edges = stored(edges, "cc-half")
    edges = edges.where("lo != hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
    return stored(edges.distinct(), "cc-links")
