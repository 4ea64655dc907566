"""Language identification with error-correcting output codes.

Every language gets a codeword (an exhaustive code for few languages, a
seeded random one with the best smallest distance beyond), and each bit of
the codewords has a binary classifier over hashed character n-grams: the
log odds of an n-gram between the languages whose bit is 1 and those whose
bit is 0.  A text's margins, one a bit, are decoded by weighted loss: for
every codeword the exponential loss of each bit, weighted by that bit
classifier's accuracy on the training sample; the nearest codeword wins.
A text whose two nearest codewords are hardly apart is flagged ambiguous.

Training reads a bounded sample of ``sample_rows`` labelled texts, chosen
by a hash of the id within each language over the whole table, and sums
n-gram counts by language in Spark; the driver holds languages x
``BUCKETS`` counts, a packed row for each of at most ``MAX_LANGUAGES``.
Scoring is one ``mapInArrow``; nothing is shuffled.

Edge cases: null text and texts without a letter are ``und`` with score 0
(not ambiguous); ties go to the first language in sorted order; with no
training text every text is ``und``; with one language every text with a
letter is that language.  Very long texts are read in blocks, with the
n-grams of the whole text.  Rows that repeat an id are predicted one by
one, and learned once.  Extra columns are not read (``keep_identified``
returns them), so their names cannot clash; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import Shipped, fold, sliced, stored, table

UNKNOWN = "und"
BUCKETS = 1 << 16
SAMPLE_ROWS = 20_000
MAX_LANGUAGES = 512
#: Text taken at a time; bounds memory for very long texts.
BLOCK_BYTES = 1 << 20
#: Confidence (0 to 1) below which a prediction is flagged ambiguous.
AMBIGUOUS = 0.1
SEED = 11
LETTER = re.compile(r"[^\W\d_]").search


def ngrams(part: bytes, starts: int | None = None) -> np.ndarray:
    """Hashed byte n-grams (2, 3 and 4 bytes) that begin in the first
    ``starts`` bytes (None: anywhere)."""
    a = np.frombuffer(part, np.uint8).astype(np.uint32)
    two = a[:-1] << 8 | a[1:]
    three = two[:-1] << 8 | a[2:]
    four = three[:-1] << 8 | a[3:]
    return np.concatenate([(x[:starts] * np.uint32(k)) >> np.uint32(16) for x, k in ((two, 0x9E3779B1), (three, 0x85EBCA6B), (four, 0xC2B2AE35))])


def blocks(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a lower-cased text, block by block: those that begin
    in it, so none is lost or added at a border."""
    data = b" " + text.lower().encode() + b" "
    for a in range(0, len(data), BLOCK_BYTES):
        yield ngrams(data[a : a + BLOCK_BYTES + 3], BLOCK_BYTES)


def codewords(n: int) -> np.ndarray:
    """(n, bits) of -1 and 1, all different, no constant bit."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:  # exhaustive: every split of the languages into two sides
        rows = [[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for b in range(1, 1 << (n - 1))] for i in range(n)]
        return np.array(rows, np.int8)
    rng = np.random.default_rng(SEED)
    bits = int(np.ceil(8 * np.log2(n)))
    best, gap = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if (abs(code.sum(axis=0, dtype=int)) == n).any():
            continue
        d = min(int((code[i] != code[j]).sum()) for i, j in combinations(range(n), 2)) if n <= 64 else int((bits - (code.astype(int) @ code.T)[~np.eye(n, dtype=bool)].max()) // 2)
        if d > gap:
            best, gap = code, d
    if best is None or gap < 1:
        raise ValueError(f"no code of {bits} bits separates {n} languages")
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # (languages, bits)
    odds: np.ndarray  # (BUCKETS, bits): log odds of an n-gram
    scale: np.ndarray  # (bits,): typical size of a margin
    weight: np.ndarray  # (bits,): accuracy-based

    def raw_margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.odds.shape[1]), 0
        for g in blocks(text):
            total += self.odds[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return total / max(n, 1)

    def decode(self, margins: np.ndarray) -> tuple[str, float]:
        """Nearest codeword by weighted exponential loss, and how clear it
        is: 1 - (smallest loss / second smallest loss)."""
        z = np.clip(margins / self.scale, -4, 4)
        loss = (np.exp(-self.code * z) * self.weight).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        if len(order) == 1:
            return self.languages[0], 1.0
        return self.languages[order[0]], float(1 - loss[order[0]] / loss[order[1]])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not text or not LETTER(text):
            return UNKNOWN, 0.0, False
        lang, score = self.decode(self.raw_margins(text))
        return lang, score, score < AMBIGUOUS


def shares(counts: dict, rows: int) -> dict:
    """How many of each language's ids a sample of ``rows`` takes: all of
    the rarest, the others alike; at least one of each."""
    left, out = rows, {}
    for k, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = max(1, min(counts[lang], left // (len(counts) - k)))
        left = max(0, left - out[lang])
    return out


def sample_languages(df: DataFrame, lang_col: str, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(lang, text) of at most ``rows`` ids (more only if there are more
    languages than rows), one row each (of several texts the largest).  The
    sample is drawn by a hash of the id within each language, so a rare
    language is learned whole beside a frequent one."""
    lang = F.col(lang_col).cast("string").alias("lang")
    # of an id with several languages the largest counts
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), lang)
    known = known.groupBy("_id").agg(F.max("lang").alias("lang")).withColumn("h", F.xxhash64(F.lit(7), "_id"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    spark = df.sparkSession
    takes = []
    for name, take in shares(counts, rows).items():
        part = min(1.0, (take + 8.0 * take**0.5 + 64.0) / counts[name])  # about that many hashes lie below
        takes.append((name, take, int(-(2**63) + part * (2**64 - 1)) if part < 1 else 2**63 - 1))
    takes = F.broadcast(spark.createDataFrame(takes, "lang STRING, take BIGINT, below BIGINT"))  # at most MAX_LANGUAGES rows
    near = known.join(takes, "lang").where(F.col("h") <= F.col("below"))  # a bounded number for each language
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "_id"))
    ids = near.withColumn("at", place).where(F.col("at") <= F.col("take")).select("_id", "lang")
    ids = F.broadcast(stored(ids, "langid-ids"))  # the sample's ids
    named = df.select(F.col(id_col).alias("own"), lang.alias("said"), F.col(text_col).alias("text"))
    rows = named.join(ids, F.col("own").eqNullSafe(F.col("_id")) & (F.col("said") == F.col("lang")))
    return rows.groupBy("_id", "lang").agg(F.max("text").alias("text")).select("lang", "text")


def train(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on the rows of ``df`` that have a language and a text with a
    letter: at most ``sample_rows`` ids (see ``sample_languages``)."""
    rows = sample_languages(df, lang_col, id_col, text_col, sample_rows)
    rows = stored(rows, "langid-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in sliced(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text and LETTER(text):
                    total = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    total[BUCKETS] += 1  # texts
                    for g in blocks(text):
                        total[:BUCKETS] += np.bincount(g, minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    counts = rows.mapInArrow(count, "lang STRING, bucket INT, n BIGINT").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def pack(cells: pa.Table) -> pa.Table:
        own = np.zeros(BUCKETS + 1, np.int64)
        own[cells["bucket"].to_numpy()] = cells["n"].to_numpy()
        return pa.table({"lang": pa.array([cells["lang"][0].as_py()], pa.string()), "cells": pa.array([own.tobytes()], pa.binary())})

    # one row of BUCKETS counts for each language
    packed = sorted(counts.groupBy("lang").applyInArrow(pack, "lang STRING, cells BINARY").collect(), key=lambda r: r["lang"])
    languages = [r["lang"] for r in packed]
    by = np.array([np.frombuffer(r["cells"], np.int64)[:BUCKETS] for r in packed], float).reshape(len(languages), BUCKETS)
    code = codewords(len(languages))
    if len(languages) < 2:
        return LanguageModel(languages, code, np.zeros((BUCKETS, code.shape[1]), np.float32), np.ones(code.shape[1]), np.ones(code.shape[1]))
    rate = (by + 0.5) / (by.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)  # each language counts alike
    odds = np.stack([np.log(rate[c > 0].mean(axis=0)) - np.log(rate[c < 0].mean(axis=0)) for c in code.T], axis=1).astype(np.float32)
    own = rate @ odds  # expected margin of each language and bit
    m = LanguageModel(languages, code, odds, np.maximum(np.abs(own).mean(axis=0) / 2, 1e-6), np.ones(code.shape[1]))
    m.weight = _weights(rows, m)
    return m


def _weights(rows: DataFrame, m: LanguageModel) -> np.ndarray:
    """log((1 - e) / e) of each bit classifier's training error e, at
    least a little above 0."""
    at = {lang: k for k, lang in enumerate(m.languages)}

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong, n = np.zeros(m.code.shape[1], np.int64), 0
        for b in sliced(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang in at and text and LETTER(text):
                    wrong += m.raw_margins(text) * m.code[at[lang]] <= 0
                    n += 1
        yield pa.RecordBatch.from_pydict({"bit": pa.array(range(len(wrong)), pa.int32()), "wrong": pa.array(wrong, pa.int64()), "n": pa.array([n] * len(wrong), pa.int64())})

    got = rows.mapInArrow(errors, "bit INT, wrong BIGINT, n BIGINT").groupBy("bit").agg(F.sum("wrong").alias("wrong"), F.sum("n").alias("n")).collect()
    weight = np.ones(m.code.shape[1])
    for r in got:
        e = (r["wrong"] + 1) / (r["n"] + 2)
        weight[r["bit"]] = max(np.log((1 - e) / e), 0.1)
    return weight


def predict(df: DataFrame, m: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) of every row."""
    held = Shipped(df.sparkSession, m, "langid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.get()
        for b in sliced(batches):
            got = [m.predict(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, "lang_pred", "score", "ambiguous"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred STRING, score DOUBLE, ambiguous BOOLEAN")


def keep_identified(df: DataFrame, m: LanguageModel, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """The rows of ``df`` with a language: ``und`` texts, and those whose
    score is below ``least_score``, are rejected."""
    held, at = Shipped(df.sparkSession, m, "langid"), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.get()
        for b in sliced(batches, at):
            got = [m.predict(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score, _ in got], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def learnable(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: those not held out."""
    return df.where(~F.coalesce(fold(F.col(id_col), 4) == 2, F.lit(False)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(learnable(docs)))
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
