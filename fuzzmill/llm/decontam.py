"""Benchmark decontamination by Wu-Manber multi-pattern search.

The alphabet is words.  Benchmark items become windows of ``WINDOW`` words
(a shorter item is one window); windows of one length share a matcher: a
table of hashed two-word blocks gives how far a window end can jump
without missing a match, a zero shift leads to the bucket of windows that
end in that block, and the window's words are compared directly.  The
matcher runs over many stretches of the text at once in numpy, each with
its own position.

The benchmark is a stated query set and never passes through the driver.
Tasks cut its items into pieces that overlap by a window less one word,
equal pieces of one item are kept once, and each task packs the pieces it
reads into blocks of about ``BLOCK_WORDS`` words, whose windows it writes to
the shared checkpoint folder, one file a block.  One ``mapInArrow`` over the
documents reads them there: it holds ``HOLD_BYTES`` of text, walks all
blocks, and keeps the last few in the worker.  So neither a block nor the
number of Python stages grows with the benchmark, an item may be longer than
a block, and a lost executor only reads again.  Documents are never shuffled.
The folder has to be one that ``pyarrow.fs`` opens (local or mounted, hdfs,
s3, gs, abfs).

Edge cases: null or empty text has no words; a very long text is tokenised
in parts and searched whole; items without words are ignored; rows that
repeat an item_id are one item and equal rows count once; a null item_id is
the item named ''; a window that several items share counts for each; rows
that repeat a document id (or have none) are searched each on its own; an
empty benchmark hits nothing, empty documents give an empty result; further
columns, whatever their names, are left out by ``find_benchmark`` and kept by
``drop_contaminated``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .util import Shipped, sliced, stored, table, worker_store

WINDOW = 10
#: Words of a block (one piece of an item more at most), and of a piece.
BLOCK_WORDS = 500_000
PIECES = 16
#: Bytes of text taken through all blocks at a time.
HOLD_BYTES = 32 << 20
#: Positions searched side by side: one for each stretch of this length.
STRETCH = 256
#: Bytes of one text tokenised at a time, and candidate pairs compared at a time.
TOKEN_BYTES = 4 << 20
COMPARE = 1 << 18

#: A-Z to a-z; bytes that are not in a word to a space.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def pieces_of(words: list[bytes], step: int, size: int = WINDOW) -> Iterator[list[bytes]]:
    """Runs of words that hold each window of ``words`` exactly once."""
    for a in range(0, max(1, len(words) - size + 1) if words else 0, step):
        yield words[a : a + step + size - 1]


class Matcher:
    """Wu-Manber tables for windows of one length, as word ids."""

    def __init__(self, windows: np.ndarray):
        self.windows = windows  # (n, m), all different
        n, self.m = windows.shape
        self.b = min(2, self.m)
        bits = max(12, int(n * self.b * 16).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        far = self.m - self.b + 1
        self.shift = np.full(1 << bits, far, np.uint8 if far < 256 else np.int64)
        for end in range(self.b - 1, self.m):  # later blocks give smaller shifts and come last
            self.shift[self._hash(windows[:, end - 1] if self.b == 2 else None, windows[:, end])] = self.m - 1 - end
        last = self._hash(windows[:, -2] if self.b == 2 else None, windows[:, -1])
        self.order = np.argsort(last, kind="stable")
        self.keys = last[self.order]

    def _hash(self, before: np.ndarray | None, word: np.ndarray) -> np.ndarray:
        h = word.astype(np.int64) * 0x9E3779B1
        if before is not None:
            h += before.astype(np.int64) * 0x85EBCA6B
        return (h ^ (h >> 15)) & self.mask

    def _block(self, ids: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._hash(ids[end - 1] if self.b == 2 else None, ids[end])

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start positions, window numbers) of all occurrences."""
        end = np.arange(self.m - 1, len(ids), STRETCH)
        stop = np.minimum(end + STRETCH, len(ids))
        found = []
        while end.size:
            step = self.shift[self._block(ids, end)]
            zero = step == 0
            if zero.any():
                found.append(end[zero])
            end = end + np.maximum(step, 1)
            on = end < stop
            end, stop = end[on], stop[on]
        starts, which = [], []
        ends = np.concatenate(found) if found else np.empty(0, np.int64)
        for a in range(0, len(ends), COMPARE // 8):
            e = ends[a : a + COMPARE // 8]
            key = self._block(ids, e)
            lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            while (hi > lo).any():  # one member of each bucket at a time
                on = hi > lo
                e, lo, hi = e[on], lo[on], hi[on]
                w = self.order[lo]
                same = (ids[e[:, None] + np.arange(1 - self.m, 1)] == self.windows[w]).all(axis=1)
                starts.append(e[same] - (self.m - 1))
                which.append(w[same])
                lo = lo + 1
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(starts), np.concatenate(which)


class Searcher:
    """All matchers of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        number: dict[str, int] = {}
        by: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, words in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int32)
            if len(ids):
                m = min(size, len(ids))
                by.setdefault(m, []).append((np.lib.stride_tricks.sliding_window_view(ids, m), number.setdefault(name, len(number))))
        self.names = list(number)
        # of each length the different windows, and the items of each: those
        # of window w are who[first[w] : first[w + 1]]
        self.tables = []
        for _, own in sorted(by.items()):
            wins, which = np.unique(np.concatenate([w for w, _ in own]), axis=0, return_inverse=True)
            item = np.repeat([k for _, k in own], [len(w) for w, _ in own])
            pairs = np.unique(np.stack([which.reshape(-1), item]), axis=1)
            self.tables.append((wins, np.searchsorted(pairs[0], np.arange(len(wins) + 1)), pairs[1].astype(np.int32)))
        self.matchers = [Matcher(wins) for wins, _, _ in self.tables]

    def __getstate__(self) -> tuple:
        return self.vocab, self.names, self.tables

    def __setstate__(self, state: tuple) -> None:
        self.vocab, self.names, self.tables = state
        self.matchers = [Matcher(wins) for wins, _, _ in self.tables]

    def ids(self, text: str | None) -> np.ndarray:
        """Word ids of a text; 0 for words of no item."""
        raw = (text or "").encode().translate(FOLD)
        parts, a = [], 0
        while a < len(raw):
            z = a + TOKEN_BYTES
            if z < len(raw):
                cut = raw.rfind(b" ", a, z)
                z = cut if cut > a else (raw.find(b" ", z) if raw.find(b" ", z) >= 0 else len(raw))
            got = self.vocab.get
            parts.append(np.array([got(w, 0) for w in raw[a:z].split()], np.int32))
            a = z
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """For each text: number of words, spans of occurrences, items."""
        each = [self.ids(t) for t in texts]
        n = np.array([len(x) for x in each], np.int64)
        first = np.concatenate(([0], np.cumsum(n + 1)))[:-1]  # a 0 between texts stops every window
        line = np.zeros(int((n + 1).sum()), np.int32)
        for a, x in zip(first.tolist(), each):
            line[a : a + len(x)] = x
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for m, (_, own, who) in zip(self.matchers, self.tables):
            start, which = m.search(line)
            doc = np.searchsorted(first, start, "right") - 1
            for d, s in zip(doc.tolist(), (start - first[doc]).tolist()):
                spans[d].append((s, s + m.m))
            for d, w in np.unique(np.stack([doc, which]), axis=1).T.tolist():
                items[d].update(self.names[k] for k in who[own[w] : own[w + 1]].tolist())
        return n, spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def blocks(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[str]:
    """Build the blocks of the benchmark in tasks; the files they are in."""
    spark, step = bench.sparkSession, max(1, block_words // PIECES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for part in pieces_of(words_of(text), step, size):
                    yield pa.RecordBatch.from_pydict({"name": [name], "words": [b" ".join(part)], "n": pa.array([len(part)], pa.int64())})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([cloudpickle.dumps(Searcher(held, size))], pa.binary())})

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = text.split()
                if n and n + len(part) > block_words:
                    yield block()
                    held, n = [], 0
                held.append((name, part))
                n += len(part)
        if held:
            yield block()

    named = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text"))
    parts = stored(named.mapInArrow(cut, "name STRING, words BINARY, n BIGINT").distinct(), "benchmark-pieces")
    total = parts.agg(F.sum("n")).first()[0]
    if not total:
        return []
    path = scratch_path(spark, "benchmark-blocks")
    built = parts.coalesce(-(-total // block_words)).mapInArrow(build, "block BINARY")
    built.write.option("maxRecordsPerFile", 1).parquet(path)
    return sorted(spark.read.schema("block BINARY").parquet(path).inputFiles())


def _load(file: str) -> Searcher:
    """A block from the shared folder; a worker keeps the last few."""
    held = worker_store("decontam").setdefault("benchmark", {})
    if file not in held:
        while len(held) >= Shipped.KEEP:
            del held[next(iter(held))]
        fs, path = pa.fs.FileSystem.from_uri(file)
        held[file] = pickle.loads(pq.ParquetFile(path, filesystem=fs).read().column(0)[0].as_py())
    return held[file]


def _walk(batches: Iterator[pa.RecordBatch], at: int, files: list[str], size: int) -> Iterator[tuple]:
    """(batch, numbers of words, spans, items) of the batches, with texts in
    column ``at``, after all blocks."""

    def through(group: list[pa.RecordBatch]) -> Iterator[tuple]:
        found = [(np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)], [set() for _ in range(b.num_rows)]) for b in group]
        for file in files or [None]:
            part = _load(file) if file else Searcher([], size)
            for b, (n, spans, items) in zip(group, found):
                own = part.search(b.column(at).to_pylist())
                n[:] = own[0]
                for d, (s, i) in enumerate(zip(own[1], own[2])):
                    spans[d] = _merged(spans[d] + s)
                    items[d] |= i
        return ((b, *f) for b, f in zip(group, found))

    group, held = [], 0
    for b in sliced(batches, at):
        if group and held + b.column(at).nbytes > HOLD_BYTES:
            yield from through(group)
            group, held = [], 0
        group.append(b)
        held += b.column(at).nbytes
    yield from through(group)


def find_benchmark(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, spans: array of [start, end) word spans inside
    occurrences, items: sorted item ids) of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    files = blocks(bench, size=size, block_words=block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, n, spans, items in _walk(batches, 1, files, size):
            spans = pa.array([[{"start": a, "end": z} for a, z in s] for s in spans], span)
            names = pa.array([sorted(s) for s in items], pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "n_words": pa.array(n, pa.int64()), "spans": spans, "items": names})

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = out.mapInArrow(run, f"id {kind}, n_words BIGINT, spans ARRAY<STRUCT<start: BIGINT, end: BIGINT>>, items ARRAY<STRING>")
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(df: DataFrame, bench: DataFrame, text_col: str = "text", size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``df`` in which no window of any item occurs."""
    at = df.columns.index(text_col)
    files = blocks(bench, size=size, block_words=block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, spans, _ in _walk(batches, at, files, size):
            yield b.filter(pa.array([not s for s in spans], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)
), spot AS (
  SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p
        FROM d, (SELECT DISTINCT m FROM wins) WHERE len(w) >= m)
), occ AS (
  SELECT doc_id, p, m, item_id FROM spot JOIN wins USING (m, win)
), hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + m)) AS word FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
