"""Group statistics, running totals and row numbers that survive a hot key.

A plain window keeps each key in one task.  These helpers cut the order into
slots, work inside a slot and add what earlier slots hold from a small table by
an equi-join, so one key may hold any share of the table.  There is one way for
all sizes, nothing runs while a plan is built, and null keys, values and order
values are treated as windows treat them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .exprs import hash_order

SLOTS = 64
SAMPLES_PER_SLOT = 8
#: Rows that a task sorts at once.
TASK_ROWS = 1 << 18


def row_total(df: DataFrame) -> Column:
    """Row count as an uncorrelated scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def deal(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over so many tasks that each has about ``TASK_ROWS`` of the ``rows``, or fewer.

    For keys whose groups are small.  The adaptive planner merges shuffled
    partitions by their bytes, far beyond ``TASK_ROWS``, but not those dealt
    here.  Only rows that the session's cores hold at once stay as they are.

    Beyond ``spark.shuffle.sort.bypassMergeThreshold`` partitions a task that
    writes them holds its whole output to sort it; up to there, nothing.  So
    there are no more tasks than that, unless the session has more itself.
    """
    spark = df.sparkSession
    tasks, partitions = -(-rows // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if tasks <= min(partitions, spark.sparkContext.defaultParallelism):
        return df
    unsorted = int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return df.repartition(max(min(tasks, unsorted), partitions), *keys)


def join_null_safe(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where null equals null."""
    right = small.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(right[f"_j_{k}"]) for k in keys])
    return df.join(right, on, how).drop(*[f"_j_{k}" for k in keys])


def attach_by_key(df: DataFrame, keys: Sequence[str], small: DataFrame) -> DataFrame:
    """Left join ``small`` (one row per key) to ``df``; null is a key like any other.

    The adaptive join splits the rows of a hot key over tasks.
    """
    return join_null_safe(df, small, list(keys))


def attach_group_stats(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Put per-key aggregates back on every row, whatever share of the table a key holds."""
    return attach_by_key(df, keys, df.groupBy(*keys).agg(*aggs))


def with_slot(df: DataFrame, order: str, out: str = "_slot", slots: int = SLOTS) -> DataFrame:
    """Adds the number of a row's range of ``order``, ranges holding about equally many distinct values.

    The bounds are quantiles of a few values per slot, picked over all rows by
    their hash, so they are even for ids of any type and spread.  They come
    from an aggregate used as a scalar subquery.  Nulls are in slot 0.
    """
    if slots <= 1:
        return df.withColumn(out, F.lit(0))
    picks = slots * SAMPLES_PER_SLOT
    name = F.col(order)
    some = df.where(name.isNotNull()).groupBy(F.pmod(F.xxhash64(name), F.lit(picks)).alias("_b")).agg(
        F.min_by(name, F.xxhash64(F.lit(1), name)).alias("_x")
    )
    along = F.sort_array(F.collect_list("_x"))
    each = F.transform(
        F.sequence(F.lit(1), F.lit(slots - 1)), lambda i: F.try_element_at(along, F.greatest(F.lit(1), F.ceil(i * F.size(along) / slots)).cast("int"))
    )
    bounds = some.agg(F.array_distinct(F.filter(each, lambda b: b.isNotNull())).alias("b")).scalar()
    return df.withColumn("_bounds", bounds).withColumn(out, F.size(F.filter("_bounds", lambda b: b < name))).drop("_bounds")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    amounts: dict[str, Column],
    slots: int = SLOTS,
    descending: bool = False,
    slot: Column | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums along ``order`` within ``keys``.

    Sums run inside a slot of the order, and the totals of earlier slots come
    from a table with one row per key and slot.
    """
    keys = list(keys)
    direction = F.desc if descending else F.asc
    along = [direction(order), *[direction(c) for c in tie]]
    df = with_slot(df, order, "_slot", slots) if slot is None else df.withColumn("_slot", slot)
    inside = W.partitionBy(*keys, "_slot").orderBy(*along).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(direction("_slot")).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_slot").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in amounts.items()])
    carried = totals.select(
        *keys, "_slot", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in amounts]
    )
    out = join_null_safe(df.withColumns({n: F.sum(c).over(inside) for n, c in amounts.items()}), carried, [*keys, "_slot"])
    return out.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in amounts}).drop("_slot", *[f"_b_{n}" for n in amounts])


def number_rows(
    df: DataFrame,
    order: str,
    out: str = "rn",
    keys: Sequence[str] = (),
    slots: int = SLOTS,
    descending: bool = False,
) -> DataFrame:
    """1-based position of each row along a unique column of any type, within ``keys``."""
    return running_total(df, keys, order, {out: F.lit(1).cast("long")}, slots, descending)


def number_by_hash(df: DataFrame, ids: Sequence[str], seed: int | str = 0, out: str = "rn", keys: Sequence[str] = ()) -> DataFrame:
    """1-based position in a reproducible random order.

    The two leading hex digits cut the order into even slots, so no task ever
    sorts the whole table.
    """
    keyed = df.withColumn("_h", hash_order(*ids, seed=seed))
    slot = F.conv(F.substring("_h", 1, 2), 16, 10).cast("int")
    return running_total(keyed, keys, "_h", {out: F.lit(1).cast("long")}, slot=slot, tie=list(ids)).drop("_h")


def cumulative_by_value(
    counts: DataFrame, keys: Sequence[str], value: str, amount: str, out: str, descending: bool = False, slots: int = SLOTS
) -> DataFrame:
    """Running sum of ``amount`` over the distinct values of each key."""
    return running_total(counts, keys, value, {out: F.col(amount)}, slots, descending)


def rank_by_value(
    df: DataFrame,
    value: str,
    order: str,
    out: str = "rn",
    keys: Sequence[str] = (),
    descending: bool = False,
    slots: int = SLOTS,
) -> DataFrame:
    """1-based position by (value, order) within ``keys``; ``order`` is a unique column.

    Rows are counted per (value, slot of the order column); running sums over
    those cells give each cell its start, and rows are numbered inside a cell.
    A value that fills a third of the table fills many cells.
    """
    keys = list(keys)
    df = with_slot(df, order, "_cell", slots)
    cells = df.groupBy(*keys, value, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    # within a value, later cells follow earlier ones whatever the direction of the value
    cells = cells.withColumn("_at", -F.col("_cell") if descending else F.col("_cell"))
    starts = running_total(cells, keys, value, {"_upto": F.col("_c")}, slots, descending, tie=["_at"])
    starts = starts.select(*keys, value, "_cell", (F.col("_upto") - F.col("_c")).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, value, "_cell").orderBy(order))
    ranked = join_null_safe(df.withColumn("_rn", inside), starts, [*keys, value, "_cell"])
    return ranked.withColumn(out, (F.col("_rn") + F.col("_before")).cast("long")).drop("_cell", "_rn", "_before")


def previous_value(df: DataFrame, order: str, value: str, out: str, slots: int = SLOTS) -> DataFrame:
    """``lag(value)`` along a unique column over the whole table, without one big window."""
    df = with_slot(df, order, "_slot", slots)
    inside = W.partitionBy("_slot").orderBy(order)
    # struct: a null value is a value
    ends = df.groupBy("_slot").agg(F.max(F.struct(order, F.struct(value).alias("_v"))).alias("_end"))
    ends = ends.select("_slot", F.lag("_end").over(W.orderBy("_slot")).alias("_prev_end"))
    return (
        join_null_safe(df.withColumn("_first", F.row_number().over(inside) == 1).withColumn("_lag", F.lag(value).over(inside)), ends, ["_slot"])
        .withColumn(out, F.when(F.col("_first"), F.col(f"_prev_end._v.{value}")).otherwise(F.col("_lag")))
        .drop("_slot", "_first", "_lag", "_prev_end")
    )
