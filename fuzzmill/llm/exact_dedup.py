"""Exact duplicates by stateful streaming deduplication.

``arrivals`` reduces every row to (digest of its normalised text, id, sig);
``ingest`` streams arrivals through a keyed RocksDB state without expiry:
for each digest the smallest id, its content locator (id and sig, the
xxhash64 of the raw text, name the row that holds the bytes) and the
number of rows.  The stream's partial aggregation meets a digest that a
third of all rows share, so no key is gathered in one task.  Feeding more
arrivals to the same state folder continues where it stopped.

``exact_duplicates`` reads the state back as a table and checks the full
bytes of every hit: rows of digests seen more than once are fetched with
their texts and compared with the text of the row that stays.  Where bytes
differ behind one digest, the rows are grouped anew by the text itself.
Both joins have two plain shuffled sides, so AQE splits a hot digest.

Everything is DataFrame and SQL functions; no Python runs on executors.

Edge cases: null text counts as empty; blanks ``[\\x20\\x09-\\x0D]+`` count as
one space; null ids sort last; of rows that repeat the smallest id, the one
with the smallest sig stays, and of identical rows exactly one; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .util import keep_rows, stored, table

#: Disk-backed state; small state partitions do not pre-allocate files, and
#: all partitions of an executor share one bound of native memory (else each
#: may hold a write buffer of 64 MB until it is full).
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def arrivals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(digest, id, sig) of every row of a batch or streaming DataFrame."""
    return df.select(digest(normalised(F.col(text_col))).alias("digest"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("sig"))


def ingest(feed: DataFrame, state_dir: str) -> None:
    """Run a stream of arrivals (see ``arrivals``) into the keyed state
    kept below ``state_dir``, until all available input is in."""
    spark = feed.sparkSession
    first = F.struct(F.col("id").isNull().alias("none"), "id", "sig")
    keyed = feed.groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        run = keyed.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
        run.option("checkpointLocation", state_dir).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_table(spark: SparkSession, state_dir: str) -> DataFrame:
    """(digest, keep_id, keep_sig, n) as the state holds them."""
    state = spark.read.format("statestore").load(state_dir).select("key.*", "value.*")
    digest, first, n = state.columns
    return state.select(F.col(digest).alias("digest"), F.col(f"{first}.id").alias("keep_id"), F.col(f"{first}.sig").alias("keep_sig"), F.col(n).alias("n"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, digest, sig."""
    spark = df.sparkSession
    feed = stored(arrivals(df, id_col, text_col, digest), "dedup-arrivals")
    state_dir = scratch_path(spark, "dedup-state")
    if feed.isEmpty():
        groups = feed.select("digest", F.col("id").alias("keep_id"), F.col("sig").alias("keep_sig"), F.lit(1).cast("bigint").alias("n"))
    else:
        path = feed.inputFiles()[0].rsplit("/", 1)[0]
        ingest(spark.readStream.schema(feed.schema).parquet(path), state_dir)
        groups = stored(state_table(spark, state_dir), "dedup-groups")

    texts = df.select(digest(normalised(F.col(text_col))).alias("digest"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("sig"), normalised(F.col(text_col)).alias("bytes"))
    hits = stored(texts.join(groups.where("n > 1"), "digest"), "dedup-hits")
    names_keeper = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sig") == F.col("keep_sig"))
    keeper = stored(hits.where(names_keeper).groupBy("digest").agg(F.min("bytes").alias("keep_bytes")), "dedup-keepers")
    checked = hits.join(keeper, "digest").select("digest", "id", "sig", "keep_id", "keep_sig", "n", (F.col("bytes") == F.col("keep_bytes")).alias("same"))
    checked = stored(checked, "dedup-checked")

    collided = checked.where("not same").select("digest").distinct()
    if not collided.isEmpty():
        bad = stored(collided, "dedup-collided")
        checked = checked.join(bad, "digest", "left_anti").unionByName(_by_bytes(hits, bad))

    winner = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sig") == F.col("keep_sig"))
    losers = checked.where(~winner).select("id", "keep_id", "n", F.lit(False).alias("kept"), "digest", "sig")
    winners = checked.where(winner).groupBy("digest", "id", "sig", "keep_id", "n").agg(F.count("*").alias("c"))
    winners = winners.select("id", "keep_id", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), "c")).alias("i"), "digest", "sig").withColumn("kept", F.col("i") == 1).drop("i")
    alone = groups.where("n = 1").select(F.col("keep_id").alias("id"), "keep_id", "n", F.lit(True).alias("kept"), "digest", F.col("keep_sig").alias("sig"))
    return alone.unionByName(losers).unionByName(winners).withColumnsRenamed({"id": id_col, "n": "group_size"})


def _by_bytes(hits: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of digests that several texts share, grouped by the text."""
    rows = stored(hits.join(bad, "digest", "left_semi").drop("keep_id", "keep_sig", "n"), "dedup-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sig")).alias("first")
    by = stored(rows.groupBy("digest", "bytes").agg(first, F.count("*").alias("n")), "dedup-by-bytes")
    return rows.join(by, ["digest", "bytes"]).select("digest", "id", "sig", F.col("first.id").alias("keep_id"), F.col("first.sig").alias("keep_sig"), "n", F.lit(True).alias("same"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    found = exact_duplicates(df, id_col, text_col)
    return keep_rows(df, found.where("kept").select(id_col, "sig"), id_col, text_col)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept,
       sha256(body) AS text_sha256
FROM t WINDOW same AS (PARTITION BY body)
"""
