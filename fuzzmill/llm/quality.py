"""Quality classifier: histogram gradient-boosted trees over document
statistics.

``statistics`` turns a whole text into a short vector (rates of character
classes, word and line shapes, repetition, compressibility).  ``fit`` bins
each statistic at quantiles of a bounded training sample and grows trees of
fixed depth on per-bin gradient sums.  The trees are complete and kept in
flat arrays (feature, threshold, leaf value by position), so a batch walks
all trees level by level with numpy indexing and no recursion.

Training reads at most ``sample_rows`` labelled documents, chosen by a hash
of the id over the whole table; only their vectors reach the driver.
Scoring is one ``mapInArrow`` over the documents; nothing is shuffled.

Edge cases: null and empty texts have the vector of an empty text and get
its score; labels other than 0 and 1 are ignored; an id with several labels
or texts counts once (its largest label and vector); with no labels, or
labels of one class, every score is that class's rate (0.5 with none).
Very long texts are counted block by block into one set of counters, with
the words and lines at a border whole.  Rows that repeat an id are scored
one by one; equal scores need no order.  Extra columns are not read, so
their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import Shipped, fold, fresh, sample_by_hash, sliced, table, worker_store

SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, RIDGE, MIN_WEIGHT = 80, 4, 0.15, 64, 1.0, 2.0
KEEP_FROM = 0.3
#: Texts are split into words and lines this many bytes at a time; the
#: statistics are those of the whole text whatever the size.
BLOCK_BYTES = 1 << 20

_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"#$%&*@^~", b"{}[]<>()=;\\/", b"'\"-_:")
_OF = np.full(256, len(_CLASSES), np.int64)
for _k, _c in enumerate(_CLASSES):
    _OF[list(_c)] = _k
_OF[128:] = len(_CLASSES) + 1
N_CLASSES = len(_CLASSES) + 2


class _Sizes:
    """Lengths of words or lines, and how many of them are different."""

    def __init__(self, short: int, long: int):
        self.n = self.total = self.squares = self.most = self.short = self.long = 0
        self.bounds, self.seen = (short, long), set()

    def add(self, items: list[bytes]) -> None:
        if not items:
            return
        size = np.fromiter(map(len, items), np.int64, len(items))
        self.n += len(items)
        self.total += int(size.sum())
        self.squares += int((size * size).sum())
        self.most = max(self.most, int(size.max()))
        self.short += int((size <= self.bounds[0]).sum())
        self.long += int((size >= self.bounds[1]).sum())
        self.seen.update(items)

    @property
    def mean(self) -> float:
        return self.total / max(self.n, 1)

    @property
    def deviation(self) -> float:
        return max(self.squares / max(self.n, 1) - self.mean**2, 0.0) ** 0.5

    def share(self, count: int) -> float:
        return count / max(self.n, 1)


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _word_blocks(data: bytes) -> Iterator[bytes]:
    """Pieces of about BLOCK_BYTES that no word crosses."""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, at + BLOCK_BYTES)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def _line_blocks(data: bytes) -> Iterator[bytes]:
    """Pieces of about BLOCK_BYTES, cut at line breaks."""
    at = 0
    while (end := data.find(b"\n", at + BLOCK_BYTES)) >= 0:
        yield data[at:end]
        at = end + 1
    yield data[at:]


N_STATISTICS = N_CLASSES + 13 + 2


def statistics(text: str | None) -> np.ndarray:
    """The vector of one whole text."""
    import zstandard

    data = (text or "").encode()
    if not data:
        return np.zeros(N_STATISTICS)
    store = worker_store("quality")
    if "quality-zstd" not in store:
        store["quality-zstd"] = zstandard.ZstdCompressor(level=1)
    zip_ = store["quality-zstd"]
    n = len(data)
    by = np.zeros(256, np.int64)
    words, lines = _Sizes(3, 12), _Sizes(0, 1)
    for part in _word_blocks(data):
        by += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        words.add(part.split())
    for part in _line_blocks(data):
        lines.add(part.split(b"\n"))
    rates = np.bincount(_OF, weights=by, minlength=N_CLASSES) / n
    p = by[by > 0] / n
    rest = [
        -(p * np.log2(p)).sum(),
        words.mean, words.deviation, words.most / n, words.share(words.short), words.share(words.long), words.share(len(words.seen)),
        lines.share(len(lines.seen)), lines.mean / n, lines.deviation / n, lines.most / n, lines.share(lines.short),
        len(zip_.compress(data)) / n,
        np.log1p(n), np.log1p(lines.n - 1),
    ]
    return np.concatenate((rates, rest))


@dataclass
class Forest:
    """Flat complete trees: node k has children 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray  # (trees, 2^depth - 1)
    above: np.ndarray  # (trees, 2^depth - 1): go right if value > above
    leaf: np.ndarray  # (trees, 2^depth)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        if not trees:
            return out
        t = np.arange(trees)
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (part[rows, self.feature[t, node]] > self.above[t, node])
            out[a : a + 4096] += self.leaf[t, node - inner].sum(axis=1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    inner = (1 << depth) - 1
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if len(y) == 0 or y.min() == y.max():
        none = np.zeros((0, inner))
        return Forest(base, none.astype(np.int64), none, np.zeros((0, inner + 1)))
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    cell = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)  # value > edge[b] iff cell > b
    flat = cell + np.arange(f) * BINS
    feature, above, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (f * BINS) + flat).ravel()
            size = width * f * BINS
            gs = np.bincount(at, np.repeat(g, f), size).reshape(width, f, BINS)
            hs = np.bincount(at, np.repeat(h, f), size).reshape(width, f, BINS)
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hl < MIN_WEIGHT) | (ht - hl < MIN_WEIGHT)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[t, first + k], above[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > above[t, node])
        node -= inner
        gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        leaf[t] = -RATE * gs / (hs + RIDGE)
        margin += leaf[t, node]
    return Forest(base, feature, above, leaf)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", rows: int = SAMPLE_ROWS, mod: int = 5) -> DataFrame:
    """Documents that may be learned from (crc32(id) mod ``mod`` is not 0),
    with their label as ``y``: at most ``rows`` ids, by a hash of the id, one
    row each (of several texts the largest)."""
    known = labels.where(F.col(label_col).isin(0, 1) & (fold(F.col(id_col), mod) != 0))
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    (y,) = fresh(docs, "y")
    picked = docs.join(F.broadcast(sample_by_hash(known.withColumnRenamed("y", y), id_col, rows)), id_col)
    rest = [c for c in docs.columns if c != id_col]
    return picked.groupBy(id_col).agg(F.max(y).alias("y"), F.max(F.struct(*rest)).alias("_row")).select(id_col, "y", "_row.*")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Forest:
    rows = labelled_sample(docs.select(id_col, text_col), labels.select(id_col, label_col), label_col, id_col, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            x = pa.array([statistics(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), x], names=["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.select(id_col, text_col, "y").mapInArrow(run, f"id {kind}, y INT, x ARRAY<DOUBLE>")
    got = got.toArrow().sort_by("id")
    x = np.array(got["x"].to_pylist(), float).reshape(-1, N_STATISTICS)
    return fit(x, np.array(got["y"].to_pylist(), float))


def score(df: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    held = Shipped(df.sparkSession, forest, "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.get()
        for b in sliced(batches):
            x = np.stack([statistics(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.scores(x), pa.float64())], names=[id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score DOUBLE")


def held_out(id_col: str = "doc_id", mod: int = 5):
    return F.coalesce(fold(F.col(id_col), mod) == 0, F.lit(False))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
