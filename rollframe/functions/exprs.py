"""Small column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: str | Column) -> Column:
    """Six places, and never a negative zero: the form results are compared in."""
    return F.round(col(c).cast("double"), 6) + F.lit(0.0)


def clamp(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    c = col(c)
    if high is not None:
        c = F.least(c, F.lit(float(high)))
    if low is not None:
        c = F.greatest(c, F.lit(float(low)))
    return c


def hash_order(*cols: str | Column, seed: int | str = 0) -> Column:
    """A reproducible pseudo-random sort key: the same in every run and partitioning."""
    return F.md5(F.concat_ws("|", *[col(c).cast("string") for c in cols], F.lit(str(seed))))


def hash_unit(*cols: str | Column, seed: int | str = 0) -> Column:
    """A reproducible uniform number in [0, 1) from the first eight hex digits."""
    digits = F.conv(F.substring(hash_order(*cols, seed=seed), 1, 8), 16, 10)
    return digits.cast("double") / F.lit(4294967296.0)


def hash_uniform(*cols: str | Column, seed: int | str = 0) -> Column:
    """The same with 52 random bits, in (0, 1): fine enough for any number of rows."""
    digits = F.conv(F.substring(hash_order(*cols, seed=seed), 1, 13), 16, 10)
    return (digits.cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def when_chain(pairs, default=None) -> Column:
    """Nested CASE from (condition, value) pairs."""
    out = None
    for cond, value in pairs:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default) if default is not None else out


def last_item(array: Column) -> Column:
    """Last element, null on an empty array."""
    return F.try_element_at(array, F.lit(-1))


def rounded(df, *plain: str | Column, **six: str | Column):
    """Select ``plain`` columns as they are and ``six`` rounded to six places under their names."""
    return df.select(*plain, *[r6(c).alias(n) for n, c in six.items()])
