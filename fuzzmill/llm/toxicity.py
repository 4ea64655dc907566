"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary
text.  A text is cut into windows, each window is compressed with either
dictionary, and the lengths are compared: a window gains what the toxic
dictionary makes it shorter.  The largest gain, the mean gain of a window
and the sum of all gains go through a logistic curve whose threshold is
calibrated on texts that the dictionaries have not seen.

What is compressed are word beginnings: each word gives the codes of its
first 4 and first 6 letters (a shorter word: of itself and its end), 16
bytes a code.  Two codes share no bytes by chance, so a match is a whole word
beginning and lengths do not depend on how spellings overlap; beginnings
cover the inflected forms of a word in languages that have many.

A dictionary's content is chosen by contrast of rates: beginnings that make
up a larger part of its class's words than of the other's (log odds of the
rates) and stand in a larger part of its texts (log odds and z-score), the
strongest nearest the end.  Rates matter: outside English the words that
mark toxic texts stand in clean ones too, but far less often.  A text counts
a beginning at most ``MOST_A_TEXT`` times, so that one repetitive text is no
evidence.  (The stock trainer keeps what is frequent, which both classes
share: held-out AUC 0.60 to 0.79 on byte windows.)

Training uses at most ``sample_rows`` labelled documents, chosen by a hash
of the id over the whole table; the driver receives at most ``ENTRIES``
beginnings a class and one short vector a calibration row.  Scoring is one
``mapInArrow``; nothing is shuffled.

Edge cases: null and empty texts have no gain and get the lowest score;
labels other than 0 and 1 are ignored; of identical labelled texts one
counts (a toxic one, if any is); with no labels, or labels of one
class, no window gains and every score is below 0.5.  Very long texts are
compressed window by window; rows that repeat an id are scored one by one;
equal scores need no order.  Extra columns are not read, so their names
cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import held_out, labelled_sample
from .util import Shipped, sliced, stored, table, worker_store

SAMPLE_ROWS = 20_000
#: Lengths of word beginnings, and codes in a window (16 bytes each: a match
#: outweighs the cost of coding it; no more than 256 bytes, from which on the
#: compressor skips positions).
STEMS = (4, 6)
WINDOW = 16
#: The compressor looks for no match in a window's last 8 bytes.
PAD = bytes(range(8))
#: A beginning tells a class apart: least log odds of its rate, least log
#: odds and z-score of its share of texts, least texts.
LEAST_ODDS, LEAST_TEXT_ODDS, LEAST_Z, LEAST_TEXTS = 2.0, 0.5, 3.5, 4
MOST_A_TEXT = 4
#: Entries of a dictionary.
ENTRIES = 1024
#: Codes kept by a worker.
CACHE = 1 << 20
WORD = re.compile(r"[^\W\d_]+")


def stems(text: str | None) -> Iterator[str]:
    """The word beginnings of a text, in order."""
    for m in WORD.finditer((text or "").lower()):
        w = m.group()
        for k in STEMS:
            if len(w) < k:
                yield w + "$"
                break
            yield w[:k]


def code(stem: str) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(stem.encode())


@dataclass
class ToxicityModel:
    toxic: bytes  # dictionary content
    ordinary: bytes
    weights: np.ndarray  # of the vector below, then the intercept
    _pair: object = None

    def __getstate__(self):
        return {**self.__dict__, "_pair": None}

    def _compressors(self):
        import zstandard as z

        if self._pair is None:
            how = z.ZstdCompressionParameters(
                window_log=15, chain_log=6, hash_log=14, search_log=1, min_match=6, target_length=1, strategy=z.STRATEGY_FAST,
                write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS,
            )
            self._pair = tuple(
                z.ZstdCompressor(dict_data=z.ZstdCompressionDict(bytes(16) + d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how)
                for d in (self.toxic, self.ordinary)
            )
        return self._pair

    def windows(self, text: str | None) -> Iterator[bytes]:
        known = worker_store("toxicity").setdefault("toxicity-codes", {})
        held: list[bytes] = []
        for s in stems(text):
            c = known.get(s)
            if c is None:
                if len(known) >= CACHE:
                    known.clear()
                c = known[s] = code(s)
            held.append(c)
            if len(held) == WINDOW:
                yield b"".join(held) + PAD
                held = []
        if held:
            yield b"".join(held) + PAD

    def gains(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        toxic, ordinary = (c.compress for c in self._compressors())
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in self.windows(text)], np.int64)

    def vector(self, text: str | None) -> np.ndarray:
        g = self.gains(text)
        if not len(g):
            return np.zeros(4)
        saved = np.maximum(g, 0)
        return np.array([saved.max(), np.log1p(saved.sum()), saved.mean(), g.mean()])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.vector(text) @ self.weights[:-1] + self.weights[-1], -50, 50))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and intercept (Newton steps), shifted so that 0.5 is the
    threshold with the fewest errors on these rows."""
    if not len(y) or y.min() == y.max():
        return np.concatenate((np.zeros(x.shape[1]), [-1.0]))
    scale = np.maximum(x.std(axis=0), 1e-9)
    a = np.column_stack((x / scale, np.ones(len(x))))
    keep = np.append(np.full(x.shape[1], ridge), 1e-6)
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep), a.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    m = a @ w
    order = np.argsort(m, kind="stable")
    m, y = m[order], y[order]
    # cut before position k: errors are the 1s before it and the 0s from it on
    wrong = np.concatenate(([0], np.cumsum(y))) + ((y == 0).sum() - np.concatenate(([0], np.cumsum(y == 0))))
    edge = np.concatenate(([m[0] - 1], (m[1:] + m[:-1]) / 2, [m[-1] + 1]))
    free = np.concatenate(([True], m[1:] > m[:-1], [True]))
    wrong = np.where(free, wrong, len(y) + 1)
    best = np.flatnonzero(wrong == wrong.min())
    w[-1] -= edge[best[len(best) // 2]]
    return np.concatenate((w[:-1] / scale, w[-1:]))


def telling_stems(learn: DataFrame) -> DataFrame:
    """(stem, y, weight): the beginnings that tell class ``y`` apart in rows
    (y, text), with the evidence of each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            seen = [Counter(), Counter()], [Counter(), Counter()]
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s, n in Counter(stems(t)).items():
                    seen[0][y][s] += min(n, MOST_A_TEXT)
                    seen[1][y][s] += 1
            names = sorted({*seen[1][0], *seen[1][1]})
            cols = {"stem": pa.array(names, pa.string())}
            for name, by in zip(("n", "texts"), seen):
                for y in (0, 1):
                    cols[f"{name}{y}"] = pa.array([by[y][s] for s in names], pa.int64())
            yield pa.RecordBatch.from_pydict(cols)

    counted = learn.mapInArrow(count, "stem STRING, n0 BIGINT, n1 BIGINT, texts0 BIGINT, texts1 BIGINT")
    counted = counted.groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "texts0", "texts1")))
    counted = stored(counted, "toxicity-stems")
    total = counted.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    texts = {r["y"]: r["count"] for r in learn.groupBy("y").count().collect()}
    odds = lambda a, b, n, m: F.log((F.col(a) + 0.5) / (n + 1.0)) - F.log((F.col(b) + 0.5) / (m + 1.0))
    out = None
    for y in (0, 1):
        own, other = f"texts{y}", f"texts{1 - y}"
        rate = odds(f"n{y}", f"n{1 - y}", total[y], total[1 - y])
        share = odds(own, other, texts.get(y, 0), texts.get(1 - y, 0))
        z = share / F.sqrt(1 / (F.col(own) + 0.5) + 1 / (F.col(other) + 0.5))
        keep = (F.col(own) >= LEAST_TEXTS) & (rate > LEAST_ODDS) & (share > LEAST_TEXT_ODDS) & (z > LEAST_Z)
        part = counted.where(keep).select("stem", F.lit(y).alias("y"), (rate * F.col(f"n{y}")).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


def dictionary(found: list[str]) -> bytes:
    """The codes of beginnings, the first of them nearest the end."""
    return b"".join(code(s) for s in reversed(found))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    spark = docs.sparkSession
    rows = labelled_sample(docs.select(id_col, text_col), labels.select(id_col, label_col), label_col, id_col, sample_rows)
    part = F.pmod(F.xxhash64(F.lit(3), id_col), F.lit(10)) < 7  # the rest calibrates
    rows = rows.select("y", F.col(text_col).alias("text"), part.alias("learn"))
    # copies of a text would pass for independent evidence: one of them counts
    rows = rows.groupBy(F.xxhash64("text")).agg(F.max(F.struct("y", "learn", "text")).alias("_row")).select("_row.*")
    rows = stored(rows, "toxicity-sample")
    told = stored(telling_stems(rows.where("learn").select("y", "text")), "toxicity-telling")
    content = {}
    for y in (0, 1):
        best = told.where(F.col("y") == y).orderBy(F.desc("weight"), "stem").limit(ENTRIES)
        content[y] = dictionary([r["stem"] for r in best.collect()])
    model = ToxicityModel(content[1], content[0], np.zeros(5))
    held = Shipped(spark, model, "toxicity")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.get()
        for b in sliced(batches):
            x = pa.array([m.vector(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], names=["y", "x"])

    # a bounded sample, put in order here: no sort in one task
    rest = rows.where("not learn").select("y", "text").mapInArrow(vectors, "y INT, x ARRAY<DOUBLE>").toArrow()
    rest = sorted(zip(rest["y"].to_pylist(), rest["x"].to_pylist()))
    x = np.array([v for _, v in rest], float).reshape(-1, 4)
    model.weights = fit_logistic(x, np.array([y for y, _ in rest], float))
    return model


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    held = Shipped(df.sparkSession, model, "toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.get()
        for b in sliced(batches):
            s = [m.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=[id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score DOUBLE")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
