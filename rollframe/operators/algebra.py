"""Row-batch algebra: projection, gather, positional join, chunks, repeats and folds.

The position of a row is its rank along a unique integer column (``order``);
it is worked out slot by slot, never in one window over the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.groups import attach_by_key, number_by_hash, number_rows, row_total


def _check(ok: Column, value: Column, message: str, kind: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast(kind))


def positions(df: DataFrame, order: str, out: str = "pos") -> DataFrame:
    """0-based position of every row."""
    return number_rows(df, order, out).withColumn(out, F.col(out) - 1)


# ---------------------------------------------------------------- columns
def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    return df.select(*names)


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def pop(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The named columns, and the rest."""
    return select_columns(df, names), df.drop(*names)


def rename_columns(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("old and new names differ in number")
    return df.withColumnsRenamed(dict(zip(old, new)))


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Prefix every name that lacks it, but for ``keep``."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keep and not c.startswith(prefix)})


# ---------------------------------------------------------------- rows
def select_rows(df: DataFrame, order: str, wanted: DataFrame | Column) -> DataFrame:
    """Rows by position list (``pick_no, pos``; repeats allowed) or by a boolean column."""
    if isinstance(wanted, Column):
        return df.where(wanted)
    # a position may be wanted any number of times
    found = attach_by_key(wanted.select("pick_no", "pos"), ["pos"], positions(df, order).withColumn("_hit", F.lit(True)))
    return found.where("_hit").drop("_hit")


def slice_rows(df: DataFrame, order: str, start: int | None = None, end: int | None = None, step: int = 1) -> DataFrame:
    """Python slice of the row order; negative bounds count from the end."""
    if step < 1:
        raise ValueError("step must be positive")
    d = positions(df, order)
    n = row_total(df)

    def bound(b: int) -> Column:
        return F.lit(b).cast("long") if b >= 0 else F.greatest(n + b, F.lit(0))

    lo = bound(start) if start is not None else F.lit(0).cast("long")
    d = d.where(F.col("pos") >= lo)
    if end is not None:
        d = d.where(F.col("pos") < bound(end))
    return d.where((F.col("pos") - lo) % step == 0) if step > 1 else d


def union_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """1:1 join on ``key``; both sides need the same keys, and shared columns must agree."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    extra = [c for c in b.columns if c not in a.columns]
    left = a.withColumn("_in_a", F.lit(True))
    right = b.withColumnsRenamed({c: f"_b_{c}" for c in shared}).withColumn("_in_b", F.lit(True))
    j = left.join(right, key, "full")
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    kinds = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    cols = [_check(both, F.col(key), f"{key} is missing on one side", kinds[key]).alias(key)]
    for c in a.columns:
        if c in shared:
            same = F.col(c).eqNullSafe(F.col(f"_b_{c}"))
            cols.append(_check(same, F.col(c), f"column {c} differs between the two sides", kinds[c]).alias(c))
        elif c != key:
            cols.append(F.col(c))
    return j.select(*cols, *extra)


def concat_rows(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def concat_meta(*parts: DataFrame, metrics: Sequence[str] = ("metrics",)) -> DataFrame:
    """Batch-level ``(name, value)`` rows of several batches: metric names keep one row per batch, others must agree."""
    tagged = concat_rows(*[p.select("name", "value", F.lit(i).alias("part")) for i, p in enumerate(parts)])
    is_metric = F.col("name").isin(*metrics)
    same = tagged.where(~is_metric).groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    agreed = same.select(
        "name", _check(F.col("lo") == F.col("hi"), F.col("lo"), "batches disagree on a batch-level value", "string").alias("value"),
        F.lit(0).alias("part"),
    )
    return agreed.unionByName(tagged.where(is_metric))


def chunk(df: DataFrame, order: str, k: int, even: bool = True) -> DataFrame:
    """Adds ``chunk_id`` for k contiguous parts; ``even`` makes an undivisible table an error."""
    n = row_total(df)
    size = F.ceil(n / F.lit(k)).cast("long")
    d = positions(df, order)
    part = F.floor(F.col("pos") / size).cast("long")
    if even:
        part = _check(n % k == 0, part, f"the number of rows is not divisible by {k}", "bigint")
    return d.withColumn("chunk_id", part).drop("pos")


def split(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``chunk_id`` for parts of ``size`` rows; the last may be shorter."""
    d = positions(df, order)
    return d.withColumn("chunk_id", F.expr(f"pos div {int(size)}")).drop("pos")


def pad_to_divisor(df: DataFrame, order: str, k: int) -> DataFrame:
    """Append copies from the start, cycled, until k divides the count; adds ``pos`` and ``is_pad``."""
    d = positions(df, order)
    n = row_total(df)
    pad = F.pmod(-n, F.lit(k))
    base = d.withColumn("is_pad", F.lit(False))
    copies = (
        d.withColumn("_n", n)
        .withColumn("_pad", pad)
        .where(F.col("pos") < F.col("_pad"))
        .withColumn("_i", F.explode(F.sequence(F.col("pos"), F.col("_pad") - 1, F.col("_n"))))
        .withColumn("pos", F.col("_n") + F.col("_i"))
        .drop("_n", "_pad", "_i")
        .withColumn("is_pad", F.lit(True))
    )
    return base.unionByName(copies)


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def reorder(df: DataFrame, order: str, permutation: DataFrame) -> DataFrame:
    """New ``pos`` of every row from ``(old_pos, new_pos)``."""
    d = positions(df, order, "old_pos").join(permutation.select("old_pos", "new_pos"), "old_pos")
    return d.drop("old_pos").withColumnRenamed("new_pos", "pos")


def repeat_rows(df: DataFrame, order: str, n: int, interleave: bool = True) -> DataFrame:
    """Every row n times; ``pos`` follows AABB with ``interleave``, else ABAB."""
    d = positions(df, order).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    pos = F.col("pos") * n + F.col("copy") if interleave else F.col("copy") * row_total(df) + F.col("pos")
    return d.withColumn("pos", pos)


def repeat_rows_by(df: DataFrame, times: str) -> DataFrame:
    """Every row as often as its own count says; 0 drops it."""
    d = df.where(F.col(times) > 0)
    return d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times).cast("long") - 1)))


def fold_rows(df: DataFrame, order: str, folds: int, columns: Sequence[str]) -> DataFrame:
    """``folds`` rows of arrays, each of as many neighbouring rows; a number of rows that ``folds`` doesn't divide is an error."""
    d = positions(df, order).withColumn("_n", row_total(df))
    fail = F.raise_error(F.concat(F.col("_n").cast("string"), F.lit(f" rows do not fold to {int(folds)}"))).cast("long")
    fold = F.when(F.col("_n") % folds != 0, fail).otherwise(F.expr(f"pos div (_n div {int(folds)})"))
    g = d.withColumn("fold_id", fold).groupBy("fold_id").agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("_r"))
    return g.select("fold_id", *[F.col(f"_r.{c}").alias(c) for c in columns])


def unfold_rows(df: DataFrame, columns: Sequence[str], key: str = "fold_id") -> DataFrame:
    """Back from arrays to rows, with ``item_no`` inside the fold."""
    z = F.arrays_zip(*[F.col(c) for c in columns])
    d = df.select(key, F.posexplode(z).alias("item_no", "_z"))
    return d.select(key, "item_no", *[F.col(f"_z.{c}").alias(c) for c in columns])


def unfold_column_chunks(df: DataFrame, n: int, columns: Sequence[str]) -> DataFrame:
    """Split array columns into n equal pieces, one row each; other columns repeat."""
    size = F.size(columns[0])
    pieces = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        *[F.slice(F.col(c), (i * (F.size(c) / n).cast("int") + 1).cast("int"), (F.size(c) / n).cast("int")).alias(c) for c in columns]
    ))
    pieces = _check(size % n == 0, pieces, f"array length is not divisible by {n}", _piece_type(df, columns))
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.posexplode(pieces).alias("piece_no", "_p")).select(
        *rest, "piece_no", *[F.col(f"_p.{c}").alias(c) for c in columns]
    )


def _piece_type(df: DataFrame, columns: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "array<struct<" + ",".join(f"{c}:{kinds[c]}" for c in columns) + ">>"


def minibatches(df: DataFrame, key: str, size: int, epochs: int = 1, seed: int | None = None) -> DataFrame:
    """Adds ``epoch`` and ``batch_id``: row order, or a seeded order per epoch; ``size`` must divide the rows."""
    n = row_total(df)
    d = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        d = number_rows(d, key, "_rn", ["epoch"])
    else:
        d = number_by_hash(d, [key, "epoch"], seed, "_rn", ["epoch"])
    batch = F.expr(f"(_rn - 1) div {int(size)}")
    batch = _check(n % size == 0, batch, f"{size} does not divide the number of rows", "bigint")
    return d.withColumn("batch_id", batch).drop("_rn")


def collate(df: DataFrame, batch: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Rows of a batch to one row of arrays, in row order.  A batch is as large as one training batch."""
    g = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_r"))
    return g.select(batch, *[F.col(f"_r.{c}").alias(c) for c in columns])


def columns_to_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Parallel array columns to one row per item."""
    return df.select(*keys, F.inline(F.arrays_zip(*[F.col(c) for c in columns])))


def batch_summary(df: DataFrame) -> DataFrame:
    """Rows, type, items and bytes of every column, from one aggregate."""
    rows = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        items = F.size(c) if kind.startswith("array") else F.lit(1)
        if kind in ("string", "binary"):
            size = F.octet_length(c)
        else:
            unit = {"double": 8, "bigint": 8, "timestamp": 8, "float": 4, "int": 4, "boolean": 1}
            size = items * unit.get(f.dataType.elementType.simpleString() if kind.startswith("array") else kind, 8)
        rows.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(kind).alias("type"), F.count(F.lit(1)).alias("rows"),
            F.sum(items).cast("long").alias("items"), (F.sum(size) / 1024**3).alias("gb"),
        ))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def frames_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that the two tables hold in different numbers, with ``surplus`` in ``a``.

    A signed count per row replaces two EXCEPT ALL passes: equal rows collapse
    before the shuffle.
    """
    names = a.columns
    both = a.withColumn("_d", F.lit(1).cast("long")).unionByName(b.withColumn("_d", F.lit(-1).cast("long")))
    return both.groupBy(*names).agg(F.sum("_d").alias("surplus")).where("surplus <> 0")


def frames_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether the tables hold the same rows equally often."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the tables have different columns")
    return frames_diff(a, b).agg((F.count(F.lit(1)) == 0).alias("equal"))
