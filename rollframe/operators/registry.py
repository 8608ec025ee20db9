"""Named user functions: dataset generators.  Advantages, losses and scorers have theirs next to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from .sampling import append_generated, slice_range

GENERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_generator(name: str, fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Name a function that makes new prompt rows from the dataset after a batch."""
    if GENERATORS.get(name, fn) is not fn:
        raise ValueError(f"generator {name!r} is already registered with another function")
    GENERATORS[name] = fn
    return fn


def generate_after_batch(dataset: DataFrame, name: str, max_len: int, length: Column | None = None) -> DataFrame:
    """The dataset with the generator's rows that pass the length filter."""
    if name not in GENERATORS:
        raise ValueError(f"unknown generator {name!r}")
    return append_generated(dataset, dataset.transform(GENERATORS[name]), max_len, length)


def first_row_again(order: str) -> Callable[[DataFrame], DataFrame]:
    """A generator that repeats the first row."""
    return lambda df: slice_range(df, order, 0, 1)
