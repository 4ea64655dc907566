"""SimHash near-duplicates by multi-index hashing.

1. ``fingerprints``: 64-bit SimHash of the word shingles of every whole
   text (numpy over Arrow batches; no shuffle).
2. ``near_links``: each distinct fingerprint is cut into two 32-bit
   segments.  Two fingerprints at distance <= 3 agree up to one bit in at
   least one segment, so the table is indexed by (segment, value) and
   every fingerprint enumerates the Hamming ball of radius 1 around each
   of its segments, fetches the table's matches and verifies the complete
   distance.  A pair whose segments differ in one bit is met from the side
   that holds a 0 there, so only 0 -> 1 flips are enumerated (17 probes a
   segment on average instead of 33).
3. ``components`` (see ``components.py``) turns links into groups.

Dense groups do not emit all their pairs: first every bucket member is
compared with the bucket's smallest one (one row per member), and the ball
search then only returns pairs that are not yet linked to the same
fingerprint.  The closure of the links is that of all pairs.

Edge cases: null or empty text has no words and fingerprint 0, linked like
any other; fewer words than a shingle give one shingle of all of them;
rows that repeat an id are separate rows with their own fingerprint; null
ids sort last, and a group of only null ids has a null component id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .util import keep_rows, sliced, stored, table

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SEGMENTS = 2
#: Shingles hashed at a time; bounds memory for very long texts.
HASH_BLOCK = 1 << 17


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z, only ASCII blanks
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    for a in range(0, n, HASH_BLOCK):
        h = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[a : a + HASH_BLOCK], ends[a : a + HASH_BLOCK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, sig BIGINT, fp BIGINT) of every row; sig is xxhash64(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = [simhash(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.int64())], names=[id_col, "sig", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col, F.xxhash64(text_col).alias("_sig")).mapInArrow(run, f"`{id_col}` {kind}, sig BIGINT, fp BIGINT")


def _segments(fp: str) -> Column:
    """The 32-bit segments of a fingerprint, each tagged with its number
    in bit 32."""
    cut = [F.shiftrightunsigned(fp, 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(s << 32)) for s in range(SEGMENTS)]
    return F.array(*cut)


def _ball(key: str) -> Column:
    """A segment value and all values with one 0 bit of it set."""
    return F.expr(f"filter(transform(sequence(-1, 31), b -> if(b < 0, {key}, {key} | shiftleft(1L, b))), (v, i) -> i = 0 or v != {key})")


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``, unique)
    whose closure is that of all pairs at ``max_bits`` or fewer differing
    bits (at most 3: one bit a segment is what the ball covers)."""
    if not 0 <= max_bits < 2 * SEGMENTS:
        raise ValueError(f"max_bits must be 0 to {2 * SEGMENTS - 1} with {SEGMENTS} segments of radius 1")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    index = fps.select("fp", F.explode(_segments("fp")).alias("key"))
    # 1. each bucket's members against its smallest one
    least = index.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    least = stored(least, "simhash-least")
    star = index.withColumnRenamed("fp", "b").join(least, "key").where((F.col("a") < F.col("b")) & near)
    star = stored(star.groupBy("b").agg(F.min("a").alias("a"), F.collect_set("a").alias("all")), "simhash-star")
    # 2. balls: matches of another star, verified over the complete distance
    known = fps.select("fp").join(star.select(F.col("b").alias("fp"), F.col("a").alias("grp")), "fp", "left")
    known = stored(known.select("fp", F.coalesce("grp", "fp").alias("grp")), "simhash-table")
    table = known.select("fp", "grp", F.explode(_segments("fp")).alias("key"))
    probes = table.select("fp", "grp", F.explode(_ball("key")).alias("key"))
    pairs = (
        probes.withColumnsRenamed({"fp": "a", "grp": "ga"})
        .join(table.withColumnsRenamed({"fp": "b", "grp": "gb"}), "key")
        .where((F.col("ga") != F.col("gb")) & near)
    )
    cross = pairs.select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct()
    return star.select(F.explode("all").alias("a"), "b").unionByName(cross)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, sig (xxhash64 of its text), fp,
    component_id (smallest id of its group) and fp_kept (the fingerprint
    of the group's smallest id)."""
    slim = stored(fingerprints(df, id_col, text_col, shingle), "simhash-fp")
    reps = stored(slim.groupBy("fp").agg(F.min(id_col).alias("rep")), "simhash-reps")
    groups = components(near_links(reps, max_bits))
    linked = stored(groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct()), "simhash-linked")
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "fp")).alias("first")
    member = reps.join(linked, reps.fp == linked.node).select("fp", "rep", "component")
    least = stored(member.groupBy("component").agg(first), "simhash-first")
    named = linked.join(least, "component").select(F.col("node").alias("fp"), "first.rep", F.col("first.fp").alias("fp_kept"))
    single = reps.join(linked, reps.fp == linked.node, "left_anti").select("fp", "rep", F.col("fp").alias("fp_kept"))
    labels = stored(named.unionByName(single), "simhash-labels")
    return slim.join(labels, "fp").select(id_col, "sig", "fp", F.col("rep").alias("component_id"), "fp_kept")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` that stay: of each group the row with the
    smallest id (of rows equal in id and text, one)."""
    found = near_duplicates(df, id_col, text_col, shingle, max_bits)
    stay = found.where(F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("fp_kept")))
    # one row of each group; several rows only repeat an id and a fingerprint
    stay = stay.groupBy("fp_kept").agg(F.first(id_col).alias(id_col), F.min("sig").alias("sig"))
    return keep_rows(df, stay.select(id_col, "sig"), id_col, text_col)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
