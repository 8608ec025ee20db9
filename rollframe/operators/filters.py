"""Row filters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.groups import attach_group_stats


def message_length(prompt: str = "prompt") -> Column:
    """Words over all messages of a prompt."""
    words = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    return F.aggregate(F.col(prompt), F.lit(0), lambda n, m: n + words(m["content"]))


def filter_overlong_prompts(df: DataFrame, max_len: int, length: Column | None = None) -> DataFrame:
    """Drop prompts longer than ``max_len``; one whose length cannot be worked out counts as too long."""
    return df.where(F.coalesce(message_length() if length is None else length, F.lit(max_len + 1)) <= max_len)


def token_length(encode) -> object:
    """A length column function from a tokenizer's ``encode``: text batches in, lengths out, null where it fails."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            try:
                return len(encode(text))
            except Exception:  # noqa: BLE001
                return None

        for b in batches:
            yield b.map(one).astype("Int32")

    return count


def filter_category(df: DataFrame, **allowed: Sequence) -> DataFrame:
    """Keep rows whose named columns are among the given values; ``details__level`` means the field ``details.level``."""
    for name, values in allowed.items():
        if values:
            values = [values] if isinstance(values, str) else list(values)
            df = df.where(F.col(name.replace("__", ".")).isin(values))
    return df


def filter_date_window(df: DataFrame, column: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Keep ``since <= date < until``; the bounds take the column's own type, so that they reach the scan."""
    kind = df.schema[column].dataType
    if since is not None:
        df = df.where(F.col(column) >= F.lit(since).cast(kind))
    if until is not None:
        df = df.where(F.col(column) < F.lit(until).cast(kind))
    return df


def filter_fenced_solution(df: DataFrame, solution: str) -> DataFrame:
    """Keep rows whose solution is one fenced python block."""
    return df.where(F.col(solution).startswith("```python") & F.col(solution).endswith("```"))


def assert_nonblank(df: DataFrame, column: str) -> DataFrame:
    """The job fails on a blank text."""
    blank = F.length(F.trim(F.regexp_replace(F.col(column), r"\s", ""))) == 0
    return df.withColumn(column, F.when(blank, F.raise_error(F.lit(f"{column} is blank")).cast("string")).otherwise(F.col(column)))


def filter_groups(rollouts: DataFrame, metric: str = "acc", key: str = "uid") -> DataFrame:
    """Drop prompt groups in which the metric does not vary; a lone rollout is kept."""
    d = attach_group_stats(rollouts, [key], [F.min(metric).alias("_lo"), F.max(metric).alias("_hi"), F.count(F.lit(1)).alias("_c")])
    return d.where((F.col("_hi") > F.col("_lo")) | (F.col("_c") == 1)).drop("_lo", "_hi", "_c")


def rollouts_search(
    df: DataFrame, keyword: str | None = None, request_id: str | None = None, texts: Sequence[str] = ("input", "output"), id_column: str = "request_id"
) -> DataFrame:
    """Samples whose texts hold a keyword, or whose request id matches without its dashes."""
    if keyword:
        hit = F.lit(False)
        for c in texts:
            hit = hit | F.col(c).contains(keyword)
        df = df.where(hit)
    if request_id:
        df = df.where(F.regexp_replace(F.col(id_column), "-", "") == request_id.replace("-", ""))
    return df

