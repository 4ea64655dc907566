"""Vector code compression with norm-of-sum bounds.

Vectors become integers and are cut into equal parts; each part position
has a codebook of up to 256 entries that some rounds of assignment and
floored means improve; a vector's code names the nearest entry of each
part (ties: lowest index).

A part's codebook falls into groups of near entries.  For each group a row
keeps a lower bound on the distance from its part to the group's entries
(its own entry left out) and the round in which that bound was measured.
All codebooks so far are kept, so in a later round the bound only loses the
*net* way that the group's entries went since its own round,
|c_j(now) - c_j(then)|: the norm of the sum of an entry's moves, which is
never more than the sum of their norms that a running bound would lose.
A row rescans exactly the groups whose bound does not exceed the exact
distance to its own entry; the others cannot hold a nearer or an equal
entry.  Bounds are rounded down and ways up, so codes are those of a full
scan.

Each round is one ``mapInArrow`` over the written table of the round
before (vectors, codes, bounds and stamps travel together: no join and no
shuffle of vectors), and one aggregate of a row per task, part and entry.
A lost executor costs a re-read; the table of a round is discarded when the
next one is complete.  The driver holds the codebooks only.

Rows whose vector is null, or holds a null or a non-finite component, are
dropped.  Repeated ids are separate rows; the first codebook orders them by
id (nulls last), then by vector.  Fewer than 256 vectors: as many entries.
Vectors of different widths, or of a width that the parts do not divide,
are an error, as are components of 2**28 or more after scaling (their
squared distances leave 64 bits).  Null labels are a label.  Extra columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .util import table

ENTRIES = 256
PARTS = 4
ROUNDS = 4
SCALE = 1024
#: Groups of a codebook, each with one bound a row.
GROUPS = 16
#: Components after scaling stay below this.
LARGEST = 1 << 28
#: Labels up to this many have their sums broadcast.
FEW_LABELS = 100_000
#: Relative allowance by which bounds are rounded down.
SLACK = 1e-6

STATE = "x BINARY, codes BINARY, bounds BINARY, stamps BINARY, error BIGINT"


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows with a vector of finite components only."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(vec_col).isNotNull() & finite)


def scaled(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as integers."""
    x = np.floor(np.asarray(vectors, np.float64) * scale)
    if x.size and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more after scaling")
    return x.astype(np.int32)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, n x len(c), as int64."""
    most = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * most * most < 1 << 53:  # every partial sum is a whole float
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, None].astype(np.int64) - c[:, j].astype(np.int64)
        out += d * d
    return out


def grouped(c: np.ndarray, groups: int = GROUPS) -> list[np.ndarray]:
    """Entry numbers in groups of near entries: halves along the widest
    coordinate, again and again."""
    found = [np.arange(len(c))]
    while len(found) < groups:
        g = max(found, key=len)
        if len(g) < 2:
            break
        found = [h for h in found if h is not g]
        wide = int(np.ptp(c[g], axis=0).argmax()) if c.shape[1] else 0
        order = g[np.argsort(c[g, wide], kind="stable")] if c.shape[1] else g
        found += [np.sort(order[: len(g) // 2]), np.sort(order[len(g) // 2 :])]
    return sorted(found, key=lambda g: int(g[0]))


def net_ways(history: list[np.ndarray], groups: list[np.ndarray]) -> np.ndarray:
    """[then, group]: the farthest that an entry of the group is now from
    where it was in round ``then``, rounded up."""
    now = history[-1].astype(np.float64)
    far = [np.sqrt(((now - old) ** 2).sum(1)) * (1 + SLACK) for old in history]
    return np.array([[f[g].max(initial=0.0) for g in groups] for f in far])


def _lower(squared: np.ndarray) -> np.ndarray:
    return (np.sqrt(squared.astype(np.float64)) * (1 - SLACK)).astype(np.float32)


def first_assignment(x, c, groups):
    """(codes, squared distances, bounds, stamps) by a full scan."""
    d = distances(x, c)
    codes = d.argmin(1)
    rows = np.arange(len(x))
    best = d[rows, codes]
    d = d.astype(np.float64)
    d[rows, codes] = np.inf
    bounds = np.stack([_lower(d[:, g].min(1)) for g in groups], 1)
    return codes, best, bounds, np.zeros(bounds.shape, np.uint8)


def next_assignment(x, history, groups, ways, codes, bounds, stamps, counter=None):
    """The same after a round, rescanning only what the bounds leave open."""
    now, c = len(history) - 1, history[-1]
    own = x.astype(np.int64) - c[codes]
    old = (own * own).sum(1)
    root = np.sqrt(old.astype(np.float64))
    net = bounds - ways[stamps, np.arange(len(groups))]
    scan = net <= root[:, None]
    best, new = old.copy(), codes.copy()
    seen = []
    for k, g in enumerate(groups):
        rows = np.flatnonzero(scan[:, k])
        if len(rows) == 0:
            seen.append(None)
            continue
        d = distances(x[rows], c[g])
        least = d.argmin(1)
        first = d[np.arange(len(rows)), least]
        better = (first < best[rows]) | ((first == best[rows]) & (g[least] < new[rows]))
        best[rows[better]], new[rows[better]] = first[better], g[least[better]]
        d = d.astype(np.float64)
        d[np.arange(len(rows)), least] = np.inf
        seen.append((rows, g[least], first, d.min(1)))
    if counter is not None:
        counter[0] += int(sum(len(g) * len(s[0]) for g, s in zip(groups, seen) if s)) + len(x)
        counter[1] += len(x) * len(c)
    bounds, stamps = bounds.copy(), stamps.copy()
    of = np.empty(len(c), np.int64)
    for k, g in enumerate(groups):
        of[g] = k
        if seen[k]:
            rows, least, first, second = seen[k]
            bounds[rows, k] = _lower(np.where(least == new[rows], second, first))
            stamps[rows, k] = now
    # an entry that a row left is now one of its group's others
    left = np.flatnonzero((new != codes) & ~scan[np.arange(len(x)), of[codes]])
    k = of[codes[left]]
    bounds[left, k] = np.minimum(np.nextafter(net[left, k].astype(np.float32), np.float32(-np.inf)), _lower(old[left]))
    stamps[left, k] = now
    return new, best, bounds, stamps


@dataclass
class Codebooks:
    """Codebooks of all rounds: [round][part] -> entries x width."""

    history: list[list[np.ndarray]]
    groups: list[list[np.ndarray]]

    @classmethod
    def start(cls, vectors: np.ndarray, parts: int, groups: int = GROUPS) -> "Codebooks":
        first = [p.astype(np.int64) for p in np.split(vectors, parts, axis=1)]
        return cls([first], [grouped(c, groups) for c in first])

    def add(self, entries: list[np.ndarray]) -> None:
        self.history.append(entries)

    @property
    def last(self) -> list[np.ndarray]:
        return self.history[-1]


def assign(state: DataFrame, books: Codebooks) -> DataFrame:
    """Codes, bounds and stamps of every row against the last codebooks."""
    parts, width = len(books.last), books.last[0].shape[1]
    entries = len(books.last[0])
    groups = len(books.groups[0])
    by_part = [[h[p] for h in books.history] for p in range(parts)]
    known = len(books.history) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = [net_ways(by_part[p], books.groups[p]) for p in range(parts)]
        names = [f.name for f in schema]
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            held = {c: b"".join(b.column(names.index(c)).to_pylist()) for c in (("x", "codes", "bounds", "stamps") if known else ("x",))}
            x = np.frombuffer(held["x"], "<i4").reshape(n, parts, width)
            new = [np.empty((n, parts), np.uint8), np.empty((n, parts, groups), "<f4"), np.empty((n, parts, groups), np.uint8)]
            error = np.zeros(n, np.int64)
            for p in range(parts):
                if known:
                    codes = np.frombuffer(held["codes"], np.uint8).reshape(n, parts)[:, p].astype(np.int64)
                    bounds = np.frombuffer(held["bounds"], "<f4").reshape(n, parts, groups)[:, p]
                    stamps = np.frombuffer(held["stamps"], np.uint8).reshape(n, parts, groups)[:, p]
                    got = next_assignment(x[:, p], by_part[p], books.groups[p], ways[p], codes, bounds, stamps)
                else:
                    got = first_assignment(x[:, p], by_part[p][0], books.groups[p])
                new[0][:, p], new[1][:, p], new[2][:, p] = got[0], got[2], got[3]
                error += got[1]
            cols = {"error": pa.array(error, pa.int64())}
            for c, v in zip(("codes", "bounds", "stamps"), new):
                cols[c] = pa.array([r.tobytes() for r in v], pa.binary())
            yield pa.RecordBatch.from_arrays([cols.get(c, b.column(i)) for i, c in enumerate(names)], names=names)

    if not 0 < entries <= 256:
        raise ValueError("a codebook holds 1 to 256 entries")
    schema = state.schema
    return state.mapInArrow(run, schema)


def means(state: DataFrame, books: Codebooks) -> list[np.ndarray]:
    """Floored means of the parts of each entry; unused entries stay."""
    parts, width, entries = len(books.last), books.last[0].shape[1], len(books.last[0])
    sums = [f"s{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4").reshape(n, parts, width)
            codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(n, parts)
            for p in range(parts):
                total[p, :, width] += np.bincount(codes[:, p], minlength=entries)
                for j in range(width):  # whole floats: rows of a batch x LARGEST is below 2**53
                    total[p, :, j] += np.bincount(codes[:, p], x[:, p, j], entries).astype(np.int64)
        p, e = np.nonzero(total[:, :, width])
        cols = [pa.array(p, pa.int32()), pa.array(e, pa.int32())]
        cols += [pa.array(total[p, e, j], pa.int64()) for j in range(width + 1)]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "entry", *sums, "n"])

    schema = ", ".join(["part INT", "entry INT", *(f"{s} BIGINT" for s in sums), "n BIGINT"])
    found = state.select("x", "codes").mapInArrow(run, schema)
    found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums))
    out = [c.copy() for c in books.last]
    for r in found.collect():  # at most parts x entries rows
        out[r["part"]][r["entry"]] = [r[s] // r["n"] for s in sums]
    return out


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def compress(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str | None = "label",
    parts: int = PARTS,
    rounds: int = ROUNDS,
    entries: int = ENTRIES,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, codes BINARY, error BIGINT) of every usable row, written
    below the scratch folder, and the codebooks (None for no rows)."""
    spark = df.sparkSession
    label = F.lit(None).cast("int") if label_col is None else F.col(label_col)
    rows = usable(df, vec_col).select(F.col(id_col).alias("id"), label.alias("label"), F.col(vec_col).alias("v"))
    seed = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"id {kinds['id']}, label {kinds['label']}, {STATE}"
    if not seed:
        return spark.createDataFrame([], schema).select("id", "label", "codes", "error"), None
    width = len(seed[0]["v"])
    if width % parts:
        raise ValueError(f"{parts} parts do not divide the width {width}")
    if rows.where(F.size("v") != width).limit(1).count():
        raise ValueError("vectors of different widths")
    books = Codebooks.start(scaled(np.array([r["v"] for r in seed], np.float64).reshape(len(seed), width), scale), parts)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False)
            x = scaled(flat.reshape(n, width), scale).astype("<i4")
            none = pa.nulls(n, pa.binary())
            cols = [b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary()), none, none, none, pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "label", "x", "codes", "bounds", "stamps", "error"])

    state, before = assign(rows.mapInArrow(whole, schema), books), None
    for r in range(rounds + 1):
        state, path = _written(state if r == 0 else assign(state, books), f"codes-{r}")
        if before:
            _discard(spark, before)
        before = path
        if r < rounds:
            books.add(means(state, books))
    return state.select("id", "label", "codes", "error"), books


def digest(entries: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for c in entries for v in c.ravel().tolist()).encode()).hexdigest()


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with the error summed over equal labels (null is one)."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    sums, _ = _written(sums, "label-errors")
    if sums.count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return label_errors(codes).select(
        F.col("id").alias("vec_id"),
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(digest(books.last) if books else None).alias("codebooks_sha256"),
    )
