"""The first k rows of an order, found by refining counts over ranges instead of sorting or numbering rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = 4096


def _range_of(x: Column, low: float, high: float) -> Column:
    """Number of the even range of [low, high] that holds x: never falls as x rises, first for low and last for high.

    Halves keep large differences finite, a power of two keeps tiny ones above zero.
    """
    half = 0.5 if max(abs(low), abs(high)) > 1e-290 else 2.0**300
    share = (x * half - low * half) / (high * half - low * half)
    return F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).cast("int")


def kth_value(df: DataFrame, value: str, k: int) -> tuple[float, int, int] | None:
    """The k-th smallest number of a column (k from 1), how many are below it and how many equal it; ``None`` if there are fewer.

    Each step counts the rows of ``RANGES`` even ranges between the least and
    the greatest value left, and goes on inside the one that holds the k-th.
    ``RANGES`` rows at most come to the driver, and a range shrinks to the
    values that are in it, so a few steps do for any spread.  Nulls and NaN
    don't count.
    """
    x = F.col(value).cast("double")
    rows = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    span = rows.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")).first()
    low, high, n, below = span["low"], span["high"], span["n"], 0
    if n < k or k < 1:
        return None
    while low < high:
        inside = rows.where(F.col("x").between(low, high))
        ranges = inside.groupBy(_range_of(F.col("x"), low, high).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        for r in sorted(ranges.collect(), key=lambda r: r["r"]):
            if below + r["n"] >= k:
                break
            below += r["n"]
        low, high, n = r["low"], r["high"], r["n"]
    return low, below, n


def among_first(df: DataFrame, keys: Sequence[str], k: int) -> Column:
    """Whether a row is among the first ``k`` by the numeric columns ``keys``, the smallest first; rows that tie in all of them count alike.

    One key is refined after the other, each among the rows that tie with the
    k-th in those before.
    """
    chosen, tied, rest = F.lit(False), F.lit(True), k
    for key in keys:
        edge = kth_value(df.where(tied), key, rest)
        if edge is None:  # fewer rows than asked for
            return chosen | tied
        value, below, equal = edge
        chosen = chosen | (tied & (F.col(key) < F.lit(value)))
        tied = tied & (F.col(key) == F.lit(value))
        rest -= below
        if equal == rest:
            break
    return F.coalesce(chosen | tied, F.lit(False))
