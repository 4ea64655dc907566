"""Row picking: first rows, coin-flip and fixed-size samples (LM-1 .. LM-5).

Randomness is a seeded md5 of the row key, so a pick is a pure function of
(table, key, seed): it does not depend on partitioning, on retries after a
lost executor, or on the engine (DuckDB computes the same md5).  Rows that
share a key are told apart by their other columns and, where those are
equal too, by an ordinal, so copies are drawn like any other rows.  Every
fixed-size pick is ``orderBy(key).limit(k)``, which Spark plans as
TakeOrderedAndProject: each task keeps its own k best rows and only
k x tasks rows reach the final merge - no full sort, no shuffle of the
table.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import estimated_tasks, scratch_path


def _key_str(id_cols: Sequence[str]) -> Column:
    # A null part has a hash of its own, so a row without a key is as
    # likely to be picked as any other.
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in id_cols]
    return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)


def hash_key(id_cols: str | Sequence[str], seed) -> Column:
    """md5 hex of ``<id>-<seed>``: a seeded uniform sort key."""
    if isinstance(id_cols, str):
        id_cols = [id_cols]
    return F.md5(F.concat(_key_str(id_cols), F.lit("-"), F.lit(str(seed))))


def coin(id_cols, seed) -> Column:
    """A fair seeded coin per row: first hex digit of the hash below 8."""
    return F.substring(hash_key(id_cols, seed), 1, 1) < F.lit("8")


# A top-k streams k rows from every task through one final task.  Beyond
# this many (k x tasks) rows, rows are filtered first (hash prefix or order-key cutoff).
TOPK_STREAM_MAX_ROWS = 50_000_000
# Repeated samples are merged in this many buckets each before the last
# step, so that no task meets the heads of all tasks.
MERGE_BUCKETS = 64


def first_k(df: DataFrame, k: int, order_col: str | Sequence[str]) -> DataFrame:
    """LM-2: the first k rows in ``order_col`` order."""
    cols = [order_col] if isinstance(order_col, str) else list(order_col)
    return df.orderBy(*cols).limit(int(k))


def coin_flip_sample(
    df: DataFrame, n: int, order_col, seed=0, id_col=None
) -> DataFrame:
    """LM-1: walk rows in ``order_col`` order, keep each on a fair coin,
    stop after n kept rows.

    Normally one top-n.  When n x tasks is large and the first order column
    is numeric, a cutoff on it is taken from ``approxQuantile`` at a rank
    that leaves at least n + margin kept rows below it even at the sketch's
    error; rows above the cutoff are dropped before the top-n (exact: every
    dropped row sorts after every survivor), and the plain top-n runs if
    fewer than n survive."""
    n = int(n)
    cols = [order_col] if isinstance(order_col, str) else list(order_col)
    key = id_col or order_col
    kept = df.where(coin(key, seed))
    plain = kept.orderBy(*cols).limit(n)
    first = cols[0]
    numeric = df.schema[first].dataType.typeName() in (
        "byte", "short", "integer", "long", "float", "double", "decimal"
    )
    if not numeric or n * estimated_tasks(df) <= TOPK_STREAM_MAX_ROWS:
        return plain
    total = kept.count()
    q = (n + 8.0 * n**0.5 + 64.0) / max(total, 1)
    err = q / 4.0
    if q + err >= 0.5:
        return plain
    cutoff = kept.approxQuantile(first, [q + err], err)[0]
    # Null keys sort first, so they survive any cutoff.
    below = F.col(first).isNull() | (F.col(first) <= F.lit(cutoff))
    top = _written(kept.where(below).orderBy(*cols).limit(n))
    return top if top.count() == n else plain


def _written(df: DataFrame) -> DataFrame:
    """A bounded sample kept in the shared scratch folder."""
    path = scratch_path(df.sparkSession, "sample")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Repeated ids up to this many are broadcast; of more, the heaviest this
#: many, so that a key left to a shuffle holds at most this share of rows.
BROADCAST_MAX_IDS = 100_000
#: Copies of a row that one generator step lays out.
COPY_BLOCK = 65_536
KEY = "__key"


def _id_hash(ids: Sequence[str]) -> list[Column]:
    """128 bits that stand for an id."""
    text = _key_str(ids)
    return [F.xxhash64(text).alias("__i1"), F.xxhash64(F.lit("#"), text).alias("__i2")]


def repeated_ids(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(__i1, __i2, n) of every id that more than one row has, written to
    the scratch folder.  The shuffle carries a hash and a count per id."""
    each = df.select(*_id_hash(ids)).groupBy("__i1", "__i2").agg(F.count(F.lit(1)).alias("n"))
    return _written(each.where(F.col("n") > 1))


def keyed_rows(
    df: DataFrame, ids: Sequence[str], seeds: Sequence, unique_id: bool = False, found: DataFrame | None = None
) -> DataFrame:
    """``df`` plus ``__key``, an array with one hash key per seed, such that
    all rows - copies of a row too - have keys of their own.

    A row whose id is its own has the key md5(id, seed).  Where several rows
    share an id, equal rows are counted, each copy gets an ordinal, and its
    key is md5(that key, the other columns, the ordinal).  Only ids that
    repeat take part in that; equal rows are combined before the shuffle,
    and a row with very many copies is laid out in blocks by many tasks.
    ``found`` is their ``repeated_ids``, where the caller has them."""
    ids = list(ids)
    base = [hash_key(ids, s) for s in seeds]
    alone = lambda rows: rows.withColumn(KEY, F.array(*base))
    if unique_id:
        return alone(df)
    found = repeated_ids(df, ids) if found is None else found
    n, most = found.agg(F.count(F.lit(1)), F.max("n")).first()
    if not n:
        return alone(df)
    h1, h2 = (h.alias(f"__row{i}") for i, h in enumerate(_id_hash(ids)))
    rows = df.select("*", h1, h2)
    same = (F.col("__row0") == F.col("__i1")) & (F.col("__row1") == F.col("__i2"))
    if n <= BROADCAST_MAX_IDS:
        side = F.broadcast(found)
        single, multi = rows.join(side, same, "left_anti"), rows.join(side, same, "left_semi")
    else:
        order = [F.desc("n"), "__i1", "__i2"]
        heavy = F.broadcast(_written(found.orderBy(*order).limit(BROADCAST_MAX_IDS)))
        rest = rows.join(heavy, same, "left_anti")
        light = found.select("__i1", "__i2")  # a key of these has at most 1 / BROADCAST_MAX_IDS of all rows
        single = rest.join(light, same, "left_anti")
        multi = rows.join(heavy, same, "left_semi").unionByName(rest.join(light, same, "left_semi"))
    copies = multi.select(*df.columns).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    copies = copies.withColumn("__b", F.explode(F.expr(f"sequence(0L, (__n - 1) div {COPY_BLOCK})")))
    if most > COPY_BLOCK:
        copies = copies.repartition(F.xxhash64(_key_str(ids), _key_str(df.columns), "__b"))
    last = f"least(__n, (__b + 1) * {COPY_BLOCK}) - 1"
    copies = copies.withColumn("__copy", F.explode(F.expr(f"sequence(__b * {COPY_BLOCK}, {last})")))
    own = _own_text(df, ids, F.col("__copy"))
    keys = F.array(*[F.md5(F.concat(b, F.lit("-"), own)) for b in base])
    return alone(single.select(*df.columns)).unionByName(copies.withColumn(KEY, keys).select(*df.columns, KEY))


def sample_k(
    df: DataFrame, k: int, seed=0, id_col: str | Sequence[str] = "id", tie: Sequence[str] = (),
    *, unique_id: bool = False, keep_key: str | None = None,
) -> DataFrame:
    """LM-3: k rows uniformly without replacement (fewer if the table is
    smaller), keyed by a seeded hash of ``id_col`` (see ``keyed_rows``): of
    rows that share an id, or are equal, each is drawn on its own, so a
    point that makes up a third of the table makes up a third of the sample.
    A null id counts as a value.  ``unique_id`` says that no id repeats and
    spares the count of ids.  ``keep_key`` names a column that returns the
    key, in whose order the rows come.

    Where ids may repeat, only rows that share their id with a row whose key
    can be among the first k are given keys (``_near_ids``); where no such id
    repeats, ids that do have no say, and all is as if ids were unique.  Normally one
    top-k.  When k x tasks is large, rows whose 32-bit hash prefix is below a
    threshold sized for ~k survivors (plus a margin) are kept first; the top
    k of the survivors is the exact answer whenever at least k survive (every
    dropped row hashes above every survivor), else the plain top-k runs."""
    k = int(k)
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    out = [*df.columns] if keep_key is None else [*df.columns, F.col(KEY).alias(keep_key)]
    order = [KEY, *ids, *tie]

    def first(rows: DataFrame, below: Column | None = None, unique: bool = unique_id, repeats: DataFrame | None = None) -> DataFrame:
        rows = keyed_rows(rows, ids, [seed], unique, repeats).withColumn(KEY, F.col(KEY)[0])
        return (rows if below is None else rows.where(below)).orderBy(*order).limit(k).select(*out)

    streams = k * estimated_tasks(df) <= TOPK_STREAM_MAX_ROWS
    if unique_id and streams:
        return first(df)
    n = df.count()
    frac = (k + 8.0 * k**0.5 + 64.0) / max(n, 1)
    if frac >= 0.5:
        return first(df)
    least = F.lit(f"{int(frac * 2**32):08x}")
    rows, repeats = df, None
    if not unique_id:
        found = _near_ids(df, ids, seed, least)
        h1, h2 = _id_hash(ids)
        rows = df.select("*", h1, h2).join(found, ["__i1", "__i2"], "left_semi").select(*df.columns)
        repeats = repeated_ids(rows, ids)
        if streams and repeats.isEmpty() and found.where("__own").count() >= k:
            return first(df, unique=True)
    top = _written(first(rows, F.col(KEY) < least, repeats=repeats))
    return top if top.count() == k else first(df)


#: A row of more copies than this counts as near without a look at their keys.
LOOK_COPIES = 64


def _near_ids(df: DataFrame, ids: Sequence[str], seed, least: Column) -> DataFrame:
    """(__i1, __i2, __own) of the ids of which a row may have a key below
    ``least``: the key that it has where its id is its own (``__own``), or one
    of those that its copies have where the id repeats.  One shuffle of
    different rows."""
    base = hash_key(ids, seed)
    out = [*_id_hash(ids), (base < least).alias("__own")]
    alone = df.where(base < least).select(*out)
    each = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    copy = lambda j: F.md5(F.concat(base, F.lit("-"), _own_text(df, ids, j))) < least
    some = F.exists(F.sequence(F.lit(0).cast("long"), F.least(F.col("__n"), F.lit(LOOK_COPIES)) - 1), copy)
    near = each.where((F.col("__n") > LOOK_COPIES) | some).select(*out)
    return _written(alone.unionByName(near).distinct())


def _own_text(df: DataFrame, ids: Sequence[str], copy: Column) -> Column:
    """What tells a row from others of its id: its other columns, and its
    number among equal rows."""
    others = [c for c in df.columns if c not in ids]
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in others], copy.cast("string"))


def _task_heads(rows: DataFrame, k: int, reps: int) -> DataFrame:
    """Of each task's rows the k first by each of ``reps`` keys, as (rep,
    __key, row): a task holds at most about 2 k rows a repeat."""
    names = [c for c in rows.columns if c != KEY]

    def first(table: pa.Table) -> pa.Table:
        return table.take(pa.compute.sort_indices(table[KEY])[:k])

    def run(batches):
        held = [None] * reps
        bound = [None] * reps  # the k-th key so far
        for b in batches:
            flat = b.column(b.schema.get_field_index(KEY))
            body = pa.Table.from_batches([b]).drop_columns([KEY])
            for r in range(reps):
                t = body.append_column(KEY, pa.compute.list_element(flat, r))
                if bound[r] is not None:
                    t = t.filter(pa.compute.less(t[KEY], bound[r]))
                held[r] = t if held[r] is None else pa.concat_tables([held[r], t])
                if held[r].num_rows >= 2 * k:
                    held[r] = first(held[r]).combine_chunks()
                    bound[r] = held[r][KEY][k - 1]
        for r in range(reps):
            if held[r] is not None and held[r].num_rows:
                t = first(held[r]).append_column("rep", pa.array([r] * min(k, held[r].num_rows), pa.int32()))
                yield from t.select([*names, KEY, "rep"]).combine_chunks().to_batches()

    kinds = {f.name: f for f in rows.schema}
    schema = T.StructType([*(kinds[c] for c in names), T.StructField(KEY, T.StringType()), T.StructField("rep", T.IntegerType())])
    return rows.mapInArrow(run, schema)


def sample_k_repeated(
    df: DataFrame, k: int, reps: int, seed=0, id_col: str | Sequence[str] = "id", *,
    unique_id: bool = False, keep_key: str | None = None,
) -> DataFrame:
    """LM-4: ``reps`` independent k-row samples, tagged ``rep``.  Repeat r
    uses seed ``<seed>.<r>`` and is ``sample_k`` with it.

    One scan serves all repeats: each task keeps its k first rows for every
    repeat, and only those are merged, by repeat and hash bucket before the
    k first of a repeat are taken."""
    k, reps = int(k), int(reps)
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    rows = keyed_rows(df, ids, [f"{seed}.{r}" for r in range(reps)], unique_id)
    heads = _task_heads(rows, k, reps)
    bucket = F.pmod(F.xxhash64(KEY), F.lit(MERGE_BUCKETS))
    near = Window.partitionBy("rep", bucket).orderBy(KEY, *ids)
    whole = Window.partitionBy("rep").orderBy(KEY, *ids)
    for w in (near, whole):
        heads = heads.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= k).drop("__at")
    return heads.select(*df.columns, "rep", *([] if keep_key is None else [F.col(KEY).alias(keep_key)]))


def random_seeds(
    df: DataFrame, k: int, seed=0, id_col: str | Sequence[str] = "id", tie: Sequence[str] = (), *, unique_id: bool = False
) -> DataFrame:
    """LM-5: k random rows to start a clusterer from (LM-3 with k = C)."""
    return sample_k(df, k, seed, id_col, tie, unique_id=unique_id)
