"""Distributed 0-based row index in a given order.

``row_number()`` over a global order runs in one task; this avoids that:

1. range-partition on the order key and sort inside each partition
   (a distributed sort);
2. tag rows with ``monotonically_increasing_id`` (partition id in the high
   bits, position in the low 33 bits) and write the result to the shared
   checkpoint folder, so later reads see the same tags even if a task is
   re-run;
3. count rows per partition (one small row per partition) and turn the
   counts into offsets.

Tags rise with the position, so a run of positions is one interval of tags:
``RowIndex.slice`` filters on it and the filter reaches the parquet scan.
The table is written once; positions are computed where they are asked for.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

IDX = "__idx"
MID = "__mid"
BROADCAST_MAX_PARTS = 100_000
_BITS = 33
_LOW = (1 << _BITS) - 1


@dataclass
class RowIndex:
    """A written table in a fixed order: ``rows`` with their tags, and for
    each partition that has rows its number and the position it starts at."""

    rows: DataFrame
    parts: list[int]
    starts: list[int]
    n: int

    def _tag(self, at: int) -> int:
        k = bisect_right(self.starts, at) - 1
        return (self.parts[k] << _BITS) + at - self.starts[k]

    def slice(self, lo: int, hi: int, keep_order: bool = False) -> DataFrame:
        """The rows at positions lo .. hi - 1 (with ``keep_order`` and their
        tags, which rise with the position)."""
        lo, hi = max(lo, 0), min(hi, self.n)
        if lo >= hi:
            rows = self.rows.limit(0)
        else:
            rows = self.rows.where((F.col(MID) >= self._tag(lo)) & (F.col(MID) <= self._tag(hi - 1)))
        return rows if keep_order else rows.drop(MID)

    def numbered(self) -> DataFrame:
        """All rows plus ``__idx``, their 0-based position."""
        offsets = self.rows.sparkSession.createDataFrame(list(zip(self.parts, self.starts)), "__p BIGINT, __off BIGINT")
        # one row per partition: broadcast while that count is small
        side = F.broadcast(offsets) if len(self.parts) <= BROADCAST_MAX_PARTS else offsets
        return (
            self.rows.join(side, F.shiftright(F.col(MID), _BITS) == F.col("__p"))
            .withColumn(IDX, F.col("__off") + F.col(MID).bitwiseAND(F.lit(_LOW)))
            .drop(MID, "__p", "__off")
        )


def row_index(df: DataFrame, order_cols: str | Sequence[str], partitions: int | None = None) -> RowIndex:
    """``df`` written in ``order_cols`` order.  Rows that tie on the order
    key are ordered by a hash of the row."""
    spark = df.sparkSession
    cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    # One range per shuffle partition, and at least one per core.
    n_parts = partitions or max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    # Ties on the order key are broken by a hash of the whole row: equal
    # keys then spread over range partitions instead of piling into one
    # (a key may hold a third of the table), and their order is fixed.
    tie = F.xxhash64(*[F.col(c) for c in df.columns]).alias("__tie")
    tagged = (
        df.withColumn("__tie", tie)
        .repartitionByRange(n_parts, *cols, "__tie")
        .sortWithinPartitions(*cols, "__tie")
        .withColumn(MID, F.monotonically_increasing_id())
        .drop("__tie")
    )
    path = scratch_path(spark, "indexed")
    tagged.write.parquet(path)
    rows = spark.read.schema(tagged.schema).parquet(path)
    counts = rows.groupBy(F.shiftright(F.col(MID), _BITS).alias("p")).count().orderBy("p").collect()
    sizes = [r["count"] for r in counts]
    return RowIndex(rows, [r["p"] for r in counts], list(accumulate(sizes, initial=0))[:-1], sum(sizes))


def with_row_index(
    df: DataFrame, order_cols: str | Sequence[str], partitions: int | None = None
) -> DataFrame:
    """``df`` plus ``__idx`` = 0-based position in ``order_cols`` order."""
    return row_index(df, order_cols, partitions).numbered()
