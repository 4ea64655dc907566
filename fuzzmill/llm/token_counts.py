"""Token counts from an exact length histogram.

Every whole text is encoded (byte-level BPE) and only its length leaves
the task.  ``histogram`` aggregates documents by encoded length, and
``suffix_sums`` adds up documents and tokens above each length, in two
levels (blocks of ``BLOCK`` lengths, then the lengths of a block), so no
task sees more than the block totals or one block.  Suffix sums at the
lengths that occur answer every context limit:

  truncated total at L = tokens_total - tokens_longer + L * docs_longer,

read at the largest length not above L; quantiles are the smallest length
at which the documents so far reach the share asked for.

Edge cases: null or empty text has 0 tokens; an empty table gives an empty
histogram; limits below the shortest length truncate every document.  Runs of
white space too long for the encoder's pattern are encoded as the one piece
the pattern makes of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import sliced, stored, table, worker_store

BLOCK = 1024
#: White space runs of at least this many characters are cut out of a text
#: before its split (the split backtracks through a run and gives up on
#: about a million).  At least 2: a single blank belongs to the next word.
LONG_RUN = 10_000
#: Characters with the White_Space property, as the split's pattern has them.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def encoder(path: str):
    """The byte-level BPE of a ranks file, loaded once in each worker."""
    store = worker_store("token_counts")
    key = ("byte-bpe", path)
    if key not in store:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        store[key] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return store[key]


def n_tokens(enc, text: str | None, long_run: int = LONG_RUN) -> int:
    """Encoded length of one whole text.  A run of white space starts a
    piece; the piece ends before the run's last character, or with the run
    where the text ends."""
    if not text:
        return 0
    n = at = 0
    for run in re.finditer(f"[{WHITE}]{{{long_run},}}", text):
        end = run.end() - (run.end() < len(text))
        n += len(enc.encode_ordinary(text[at : run.start()])) + len(enc._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(enc.encode_ordinary(text[at:]))


def token_lengths(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in sliced(batches):
            n = [n_tokens(enc, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens BIGINT")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): one row for each encoded length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """(n_tokens, n_docs, docs_longer, tokens_longer, docs_total,
    tokens_total, truncated_total, quantile) for each length as a context
    limit: documents and tokens of longer documents, the corpus total cut
    at the limit, and the share of documents that fit."""
    hist = stored(hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "token-histogram")
    tokens = F.col("n_docs") * F.col("n_tokens")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(tokens).alias("bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("later_d"), F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("later_t"),
        F.sum("bd").over(whole).alias("docs_total"), F.sum("bt").over(whole).alias("tokens_total"),
    )
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = hist.select("*", F.coalesce(F.sum("n_docs").over(own), F.lit(0)).alias("own_d"), F.coalesce(F.sum(tokens).over(own), F.lit(0)).alias("own_t"))
    rows = rows.join(blocks, "block").withColumns({"docs_longer": F.col("own_d") + F.col("later_d"), "tokens_longer": F.col("own_t") + F.col("later_t")})
    return rows.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer", "docs_total", "tokens_total",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
        (1 - F.col("docs_longer") / F.col("docs_total")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, docs_longer, tokens_kept, tokens_total) for a stated
    list of limits, from the suffix sums alone: one aggregate, no join.  An
    empty histogram gives nulls."""
    limits = sorted({int(x) for x in limits})
    last = F.struct("n_tokens", "docs_longer", "tokens_longer")
    aggs = [F.max(F.when(F.col("n_tokens") <= x, last)).alias(f"l{k}") for k, x in enumerate(limits)]
    row = sums.agg(F.max("docs_total").alias("docs_total"), F.max("tokens_total").alias("tokens_total"), *aggs)
    out = []
    for k, x in enumerate(limits):
        docs = F.coalesce(F.col(f"l{k}.docs_longer"), F.col("docs_total"))
        kept = F.col("tokens_total") - F.coalesce(F.col(f"l{k}.tokens_longer"), F.col("tokens_total")) + x * docs
        out.append(F.struct(F.lit(x).cast("bigint").alias("context_limit"), docs.alias("docs_longer"), kept.alias("tokens_kept"), "tokens_total"))
    return row.select(F.inline(F.array(*out)))


def quantile(sums: DataFrame, share: float) -> int | None:
    """Smallest length that at least ``share`` of the documents fit in."""
    return sums.where(F.col("docs_total") - F.col("docs_longer") >= F.lit(share) * F.col("docs_total")).agg(F.min("n_tokens")).first()[0]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(token_lengths(table(spark, sf_dir, "documents"), tokenizer_path())))
