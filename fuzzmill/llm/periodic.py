"""Periodic runs of words, found by scale-tiled distribution.

A run is a stretch of words that repeats with its smallest period q at
least four times (and has at least six words), extended as far as the
period holds.  A word is redundant if a run contains it after that run's
first q words.

1. ``explode``: for every octave of periods [P, 2P) a document has
   boundaries at each multiple of 2P.  A run of the octave has a boundary b
   near its start at which the next q words come twice, so only boundaries
   with such a square are kept (64-bit hashes of P words, doubled from
   octave to octave; a collision costs time, never a run).  They are put
   into overlapping tiles: the words from 2P before a tile's first kept
   boundary to 6P after its last one.
2. ``solve``: tiles are dealt out by (document, octave, place), so that the
   tiles of one long document spread over tasks, and solved alone.  At each
   boundary the Z-function of the words behind it gives all periods of the
   octave that hold there and which of them are multiples of a smaller one;
   the stretch on which a period holds, cut at the tile's reach, is one
   interval fragment.
3. ``stitch``: fragments are shuffled by (document, period) and touching
   ones become one run.
4. ``collapse``: runs meet the texts that have any (only those texts are
   shuffled) and the redundant words go.

Documents are told apart by a 128-bit digest of id and words, so rows that
repeat an id are separate documents, and rows that repeat id and text have
equal fragments, which stitch to the same runs: each gets its own result
row.  Null and empty texts have no words: no run, the digests of nothing.
A null id is a document like any other.  Very long texts are tokenised in
blocks and held as 4-byte word numbers; a tile never holds more than 24 P
(or about 1,100) words beyond what one run of its octave needs.  Equal
exponents: smallest start, then smallest period.  Extra columns are not
read, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import sliced, stored, table

LEAST_POWER = 4
LEAST_WORDS = 6
#: Words in the core of a tile of small periods (16 P for larger ones).
CORE = 1024
#: Texts are split into words this many bytes at a time.
BLOCK = 1 << 20
#: Hash comparisons made at a time.
CHUNK = 1 << 20

BLANK = re.compile(rb"[\x20\x09-\x0D]")
NOTHING = hashlib.sha256(b"").hexdigest()


def number_words(text: str | None, vocabulary: dict) -> np.ndarray:
    """The words of a text as numbers in ``vocabulary``, which grows."""
    data = (text or "").encode()
    number = vocabulary.setdefault
    parts, at = [], 0
    while at < len(data):
        cut = BLANK.search(data, at + BLOCK)
        end = cut.start() if cut else len(data)
        parts.append(np.array([number(w, len(vocabulary)) for w in data[at:end].split()], np.int32))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def planted(ids: np.ndarray, doc_id: str | None) -> np.ndarray:
    """The contract's rewriting: a document in ten repeats the words from
    place a with period p."""
    n, h = len(ids), crc32(doc_id.encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((ids[:a], ids[a + np.arange(n - a) % p]))


def as_given(ids: np.ndarray, doc_id: str | None) -> np.ndarray:
    return ids


def _joined(words: list, ids: np.ndarray) -> Iterator[bytes]:
    """The words named by ``ids`` joined by one space, in pieces."""
    for at in range(0, len(ids), BLOCK):
        yield (b" " if at else b"") + b" ".join([words[i] for i in ids[at : at + BLOCK].tolist()])


def _sha(pieces: Iterator[bytes]) -> "hashlib._Hash":
    h = hashlib.sha256()
    for x in pieces:
        h.update(x)
    return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _squares(h: np.ndarray, at: np.ndarray, P: int) -> np.ndarray:
    """The places of ``at`` at which, by the hashes ``h`` of P words, a
    square of a period in [P, 2P) begins."""
    reach = np.lib.stride_tricks.sliding_window_view(h, P)
    step = max(1, CHUNK // P)
    out = []
    for i in range(0, len(at), step):
        b = at[i : i + step]
        row, q = np.nonzero(reach[b + P] == h[b][:, None])
        if len(row) == 0:
            continue
        b, q = b[row], q + P
        end = np.minimum(b + 2 * q - P, len(h) - 1)
        if P == 1:  # two words more, so that "the the" alone is none
            end = np.minimum(b + 2, len(h) - 1)
        out.append(np.unique(b[h[b + q - P] == h[end]]))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def square_boundaries(docs: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(document, P, kept boundaries) for every octave of every document
    that has any; all documents are hashed at once."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    sizes = np.array([len(docs[i]) for i in order], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # one number between two documents that no word has
    h = np.empty(starts[-1], np.uint64)
    for k, i in enumerate(order):
        h[starts[k] : starts[k + 1] - 1] = docs[i]
        h[starts[k + 1] - 1] = (1 << 40) + k
    h = _mixed(h)
    P = 1
    while True:
        live = int(np.searchsorted(-sizes, -LEAST_POWER * P, side="right"))  # documents long enough
        if not live:
            return
        h = h[: starts[live]]
        counts = (sizes[:live] - 2 * P) // (2 * P) + 1
        first = np.concatenate(([0], np.cumsum(counts)))
        owner = np.repeat(np.arange(live), counts)
        at = starts[owner] + 2 * P * (np.arange(first[-1]) - first[owner])
        kept = _squares(h, at, P)
        owner = np.searchsorted(starts, kept, side="right") - 1
        for k in np.unique(owner).tolist():
            yield order[k], P, kept[owner == k] - starts[k]
        nxt = np.zeros_like(h)
        m = len(h) - P
        if m > 0:
            nxt[:m] = _mixed(h[:m] ^ (h[P : P + m] << np.uint64(1)) ^ (h[P : P + m] >> np.uint64(63)))
        h = nxt
        P *= 2


def tiles_of(ids: np.ndarray, P: int, kept: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first word, boundaries from there, words) of each tile."""
    core = max(16 * P, CORE)
    for group in np.split(kept, np.flatnonzero(np.diff(kept // core)) + 1):
        lo, hi = max(0, int(group[0]) - 2 * P), min(len(ids), int(group[-1]) + 6 * P)
        yield lo, (group - lo).astype(np.int32), ids[lo:hi]


EXPLODED = "key BINARY, octave INT, at BIGINT, boundaries BINARY, words BINARY, digest STRING, text BINARY"


def explode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite=as_given) -> DataFrame:
    """One row per document (``octave`` null: its digest, or its text if a
    tile of it exists) and one row per tile."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            vocabulary: dict = {}
            names = b.column(2).to_pylist()
            ids = [rewrite(number_words(t, vocabulary), i) for t, i in zip(b.column(1).to_pylist(), names)]
            words = list(vocabulary)
            whole = [_sha(_joined(words, x)) for x in ids]
            keys = [
                hashlib.blake2b(repr(i).encode() + d.digest(), digest_size=16).digest()
                for i, d in zip(names, whole)
            ]
            tiled, out = set(), []
            for k, P, kept in square_boundaries(ids):
                tiled.add(k)
                for lo, marks, part in tiles_of(ids[k], P, kept):
                    out.append((k, P, lo, marks.tobytes(), part.tobytes(), None, None))
            for k, d in enumerate(whole):
                text = b"".join(_joined(words, ids[k])) if k in tiled else None
                out.append((k, None, None, None, None, None if k in tiled else d.hexdigest(), text))
            rows, *rest = zip(*out)
            cols = [pa.array([keys[k] for k in rows], pa.binary())]
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.binary())
            cols += [pa.array(v, t) for v, t in zip(rest, kinds)]
            cols.append(b.column(0).take(pa.array(rows, pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in EXPLODED.split(", ")] + ["id"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("name"))
    return read.mapInArrow(run, f"{EXPLODED}, id {kind}")


def z_function(s: list) -> list:
    """z[i]: how many items from i on equal those from 0 on."""
    n = len(s)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right or i >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


@lru_cache(1 << 16)
def _prime_parts(q: int) -> tuple:
    """q / r for each prime r that divides q."""
    out, r, x = [], 2, q
    while r * r <= x:
        if x % r == 0:
            out.append(q // r)
            while x % r == 0:
                x //= r
        r += 1
    return tuple(out + [q // x] if x > 1 else out)


def fragments_of(words: np.ndarray, boundaries: np.ndarray, P: int) -> Iterator[tuple[int, int, int]]:
    """(period, lo, hi): words i of [lo, hi) equal words i + period, cut at
    the reach of the tile's boundaries; fragments of a period that touch
    within the tile are one."""
    items = words.tolist()
    open_: dict[int, list[int]] = {}
    for b in boundaries.tolist():
        z = z_function(items[b : b + 6 * P])
        for q in range(P, min(2 * P, len(z))):
            if z[q] < q or any(z[d] >= q - d for d in _prime_parts(q)):
                continue
            lo = b
            while lo > 0 and lo > b - 2 * P and items[lo - 1] == items[lo - 1 + q]:
                lo -= 1
            hi = b + min(z[q], 4 * P)
            held = open_.get(q)
            if held and lo <= held[1]:
                held[0], held[1] = min(held[0], lo), max(held[1], hi)
                continue
            if held:
                yield q, *held
            open_[q] = [lo, hi]
    for q, held in open_.items():
        yield q, *held


def solve(tiles: DataFrame) -> DataFrame:
    """Interval fragments (key, period, lo, hi) of tile rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, P, at, marks, words in zip(*(c.to_pylist() for c in b.columns)):
                found = fragments_of(np.frombuffer(words, np.int32), np.frombuffer(marks, np.int32), P)
                out += [(key, q, at + lo, at + hi) for q, lo, hi in found]
            if out:
                cols = [pa.array(v, t) for v, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "period", "lo", "hi"])

    dealt = tiles.select("key", "octave", "at", "boundaries", "words").repartition("key", "octave", "at")
    return dealt.mapInArrow(run, "key BINARY, period BIGINT, lo BIGINT, hi BIGINT")


def stitch(fragments: DataFrame, least_power: int = LEAST_POWER, least_words: int = LEAST_WORDS) -> DataFrame:
    """Runs (key, start, length, period) of fragments: touching intervals
    of a period become one."""
    by = Window.partitionBy("key", "period").orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parts = fragments.distinct().withColumn("opens", (F.coalesce(before, F.lit(-1)) < F.col("lo")).cast("int"))
    parts = parts.withColumn("run", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = parts.groupBy("key", "period", "run").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    runs = runs.select("key", "start", (F.col("hi") - F.col("start") + F.col("period")).alias("length"), "period")
    return runs.where(F.col("length") >= F.greatest(F.lit(least_words), least_power * F.col("period")))


COLLAPSED = (
    "n_runs BIGINT, start BIGINT, length BIGINT, period BIGINT, exponent_milli BIGINT, runs_sha256 STRING, collapsed_sha256 STRING"
)


def collapse(text: bytes, runs: list) -> bytes:
    """The words of ``text`` (joined by one space) that no run makes
    redundant; ``runs`` holds (start, period, length)."""
    words = text.split(b" ") if text else []
    drop = np.zeros(len(words), bool)
    for start, period, length in runs:
        drop[start + period : start + length] = True
    return b" ".join([words[i] for i in np.flatnonzero(~drop).tolist()])


def _summary(text: bytes, runs: list) -> tuple:
    lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
    best = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]), default=None)
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapse(text, runs)).hexdigest()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite=as_given) -> DataFrame:
    """One row per document: id, n_runs, the run of greatest exponent and
    the digests of all runs and of the collapsed text."""
    parts = stored(explode(docs, id_col, text_col, rewrite), "periodic-tiles")
    runs = stitch(solve(parts.where("octave IS NOT NULL")))
    listed = runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    texts = parts.where("octave IS NULL AND text IS NOT NULL").select("key", "id", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col] + [x.split()[0] for x in COLLAPSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            out = []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out.append(_summary(text, [(r["start"], r["period"], r["length"]) for r in found or []]))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, t) for v, t in zip(zip(*out), kinds))], names=names)

    some = texts.join(listed, "key", "left").select("id", "text", "runs").mapInArrow(run, f"`{id_col}` {kind}, {COLLAPSED}")
    none = parts.where("octave IS NULL AND text IS NULL").select(
        F.col("id").alias(id_col),
        F.lit(0).cast("long").alias("n_runs"),
        *(F.lit(None).cast("long").alias(c) for c in names[2:6]),
        F.lit(NOTHING).alias("runs_sha256"),
        F.col("digest").alias("collapsed_sha256"),
    )
    return some.unionByName(none)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted)
