"""Sampling, splitting, ordering and limits.

Random choices order rows by a hash of a stable key and a seed: the same rows
come out in every run and under every partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import hash_order, hash_uniform, hash_unit
from ..functions.groups import SAMPLES_PER_SLOT, SLOTS, number_by_hash, number_rows, rank_by_value, row_total
from ..schemas import TESTS
from ..session import cut


def sample_n(df: DataFrame, key: str, n: int, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """The first n rows, or n random ones without replacement.  Apply it before any length filter.

    Rows are chosen by their number, so no task holds the n of them.
    """
    if n <= 0:
        return df
    numbered = number_by_hash(df, [key], seed, "_rn") if shuffle else number_rows(df, key, "_rn")
    return numbered.where(F.col("_rn") <= n).drop("_rn")


def split_by_ratio(df: DataFrame, key: str, test_ratio: float, seed: int = 42, exact: bool = False) -> DataFrame:
    """Adds ``split``: by hash bucket (about the ratio), or the exact ``ceil(ratio * rows)`` test rows."""
    if not exact:
        return df.withColumn("split", F.when(hash_unit(key, seed=seed) < test_ratio, "test").otherwise("train"))
    n_test = F.ceil(row_total(df) * F.lit(test_ratio))
    d = number_by_hash(df, [key], seed, "_rn")
    return d.withColumn("split", F.when(F.col("_rn") <= n_test, "test").otherwise("train")).drop("_rn")


def split_head_tail(df: DataFrame, order: str, head: float = 0.75, tail: float = 0.25) -> DataFrame:
    """The first and the last share by position, tagged train and test; shares may overlap."""
    n = row_total(df)
    d = number_rows(df, order, "_rn").withColumn("_n", n)
    in_head = F.col("_rn") <= F.round(F.col("_n") * head)
    in_tail = F.col("_rn") > F.col("_n") - F.round(F.col("_n") * tail)
    tags = F.filter(F.array(F.when(in_head, F.lit("train")), F.when(in_tail, F.lit("test"))), lambda x: x.isNotNull())
    return d.withColumn("split", F.explode(tags)).drop("_rn", "_n")


def split_holdout_groups(
    df: DataFrame, group: str, key: str, n_train: int = 40, n_test: int = 10, n_ood: int = 20, ood_group=None, seed: int = 0
) -> DataFrame:
    """One whole group is out-of-distribution test; in the others a shuffled head trains and the next rows test.

    Without ``ood_group`` the group first in hash order is held out.  Only the
    leading rows of a group are ranked, cut to that many before the shuffle.
    """
    if ood_group is None:
        pick = df.agg(F.min_by(group, F.struct(hash_order(group, seed=seed), group))).scalar()
    else:
        pick = F.lit(ood_group)
    most = max(n_train + n_test, n_ood)
    rank = F.row_number().over(W.partitionBy(group).orderBy(hash_order(group, key, seed=seed), key))
    d = df.withColumn("_rk", rank).where(F.col("_rk") <= most)
    out = F.col(group) == pick
    tag = (
        F.when(out & (F.col("_rk") <= n_ood), "test_out_of_distribution")
        .when(out, F.lit(None))
        .when(F.col("_rk") <= n_train, "train")
        .when(F.col("_rk") <= n_train + n_test, "test_in_distribution")
    )
    return d.withColumn("split", tag).where("split is not null").drop("_rk")


def _kept_items(key: str, n: Column, frac: float, seed: int) -> Column:
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(hash_order(key, i, seed=seed).alias("h"), i.alias("i"))))
    keep = F.greatest(F.lit(1), F.floor(n * F.lit(frac)).cast("int"))
    return F.array_sort(F.transform(F.slice(ranked, F.lit(1), keep), lambda r: r["i"]))


def sample_tests(df: DataFrame, key: str, tests: str = "tests", frac: float = 0.5, seed: int = 0) -> DataFrame:
    """Keep ``max(1, int(frac * n))`` test pairs of each row, in their order; adds both counts."""
    d = df.withColumn("_t", F.from_json(tests, TESTS)).withColumn("n_tests", F.size("_t.inputs"))
    d = d.withColumn("_k", F.when(F.col("n_tests") > 0, _kept_items(key, F.col("n_tests"), frac, seed)).otherwise(F.array().cast("array<int>")))
    pick = lambda c: F.transform("_k", lambda i: F.get(F.col(f"_t.{c}"), i))
    new = F.struct(
        pick("inputs").alias("inputs"), pick("outputs").alias("outputs"),
        F.col("_t.testtype").alias("testtype"), F.col("_t.fn_name").alias("fn_name"), F.col("_t.time_limit").alias("time_limit"),
    )
    return d.withColumn(tests, F.to_json(new)).withColumn("n_kept", F.size("_k")).drop("_t", "_k")


def test_counts(sampled: DataFrame) -> DataFrame:
    """Mean number of tests per row before and after sampling."""
    return sampled.agg(F.avg("n_tests").alias("mean_tests"), F.avg("n_kept").alias("mean_kept"))


def slice_range(df: DataFrame, order: str, start: int = 0, n: int | None = None) -> DataFrame:
    d = number_rows(df, order, "_rn").where(F.col("_rn") > start)
    return (d.where(F.col("_rn") <= start + n) if n is not None else d).drop("_rn")


def split_equal(df: DataFrame, order: str, k: int, uneven: bool = False) -> DataFrame:
    """Adds ``part`` for k equal contiguous parts; an undivisible table is an error.

    With ``uneven`` its parts differ by a row at most.
    """
    n = row_total(df)
    d = number_rows(df, order, "_rn")
    part = F.floor((F.col("_rn") - 1) / (n / F.lit(k))).cast("long")
    if uneven:
        return d.withColumn("part", part).drop("_rn")
    fail = F.raise_error(F.lit(f"the number of rows is not divisible by {k}")).cast("long")
    return d.withColumn("part", F.when(n % k == 0, part).otherwise(fail)).drop("_rn")


def shard(df: DataFrame, order: str, k: int) -> DataFrame:
    """Adds ``shard`` for k strided shards."""
    return number_rows(df, order, "_rn").withColumn("shard", (F.col("_rn") - 1) % k).drop("_rn")


def split_singletons(df: DataFrame, copies: int = 4) -> DataFrame:
    """Every question ``copies`` times, for one dataset per question."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def epoch_order(df: DataFrame, key: str, batch_size: int, epochs: int = 1, seed: int | None = None) -> DataFrame:
    """Adds ``epoch, batch_id, slot``; rows in order or newly shuffled per epoch, the last partial batch dropped."""
    full = F.floor(row_total(df) / F.lit(batch_size))
    d = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    d = number_rows(d, key, "_rn", ["epoch"]) if seed is None else number_by_hash(d, [key, "epoch"], seed, "_rn", ["epoch"])
    d = d.withColumn("batch_id", F.expr(f"(_rn - 1) div {int(batch_size)}")).withColumn("slot", (F.col("_rn") - 1) % batch_size)
    return d.where(F.col("batch_id") < full).drop("_rn")


def curriculum_weights(prompts: DataFrame, history: DataFrame, key: str = "uid") -> DataFrame:
    """Adds the success rate so far, its distance to one half, and ``place``: the most undecided prompts first."""
    rate = history.groupBy(key).agg(F.avg("score").alias("success_rate"))
    d = prompts.join(rate, key, "left").withColumn("distance", F.abs(F.coalesce("success_rate", F.lit(0.5)) - 0.5))
    return rank_by_value(d, "distance", key, "place")


def resample_weights(score: Column, method: str, power: float, extremes: Mapping[str, Column]) -> Column:
    if method == "pow":
        w = F.pow(F.abs(score), F.lit(float(power)))
    elif method == "max_min":
        w = F.when((score == extremes["hi"]) | (score == extremes["lo"]), 1.0).otherwise(0.0)
    elif method == "max_random":
        w = F.when(score == extremes["hi"], 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown method {method!r}")
    return F.greatest(w + 1e-8, F.lit(1e-8))


def _bounds(values: list, slots: int) -> list:
    """At most ``slots`` - 1 values that cut sorted ones into even ranges."""
    return sorted({values[-(-i * len(values) // slots) - 1] for i in range(1, slots)}) if values else []


def _slot(x: Column, bounds: list, kind: T.DataType) -> Column:
    """Number of the range of ``x``: how many bounds are below it."""
    return F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]).cast(T.ArrayType(kind)), lambda b: b < x))


def _some(df: DataFrame, column: str, slots: int) -> list:
    """A few values per slot, picked over all rows by their hash, in order."""
    name = F.col(column)
    picks = df.where(name.isNotNull()).groupBy(F.pmod(F.xxhash64(name), F.lit(slots * SAMPLES_PER_SLOT)).alias("_b"))
    return [r["x"] for r in picks.agg(F.min_by(name, F.xxhash64(F.lit(1), name)).alias("x")).select("x").distinct().orderBy("x").collect()]


def resample_by_score(
    df: DataFrame, order: str = "traj_id", score: str = "score", method: str = "pow", power: float = 2.0, seed: int = 0, slots: int = SLOTS
) -> DataFrame:
    """As many draws with replacement as rows, in proportion to a weight of the score; ``(draw, order)``.

    A draw is a uniform number on the line of running weights and takes the row
    with the smallest total above it.  The split goes from slots to rows: ids are
    cut into ``slots``, whose weights are summed first, so that a row's total is
    its slot's start and a running sum inside the slot.  Then rows and draws are
    cut together into slots of the line that hold about equally many of both,
    and meet inside those; a draw behind a slot's last total takes the next
    slot's first.  A row of any weight is one point of the line.

    Starts, bounds and first totals are a value per slot, found by small jobs
    when this is called; ids and scores, then totals, are written once.
    """
    df = cut(df.select(order, score))
    kind = df.schema[order].dataType
    ends = df.agg(F.max(score).alias("hi"), F.min(score).alias("lo")).first()
    extremes = {n: F.lit(ends[n]) for n in ("hi", "lo")}
    d = df.select(order, resample_weights(F.col(score), method, power, extremes).alias("_w"))
    d = d.withColumn("_slot", _slot(F.col(order), _bounds(_some(df, order, slots), slots), kind))
    mass = {r["_slot"]: r["m"] for r in d.groupBy("_slot").agg(F.sum("_w").alias("m")).collect()}
    starts, whole = [], 0.0
    for i in range(slots):
        starts.append(whole)
        whole += mass.get(i, 0.0)
    inside = W.partitionBy("_slot").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    start = F.element_at(F.array(*[F.lit(x) for x in starts]), F.col("_slot") + 1)
    rows = cut(d.select(order, (start + F.sum("_w").over(inside)).alias("_total")))
    top = rows.agg(F.max(F.struct("_total", order)).alias("top")).first()["top"]
    if top is None:
        return df.select(F.col(order).alias("draw"), F.col(order))
    # every row stands for its total and for one draw
    total = F.struct(F.col("_total").alias("_x"), F.lit(True).alias("_is_row"))
    draw = F.struct((hash_uniform(order, seed=seed) * F.lit(top["_total"])).alias("_x"), F.lit(False).alias("_is_row"))
    points = rows.select(order, F.inline(F.array(total, draw)))
    line = points.withColumn("_slot", _slot(F.col("_x"), _bounds(_some(points, "_x", slots), slots), T.DoubleType()))
    row = F.when(F.col("_is_row"), F.struct("_x", order))
    first = {r["_slot"]: r["m"] for r in line.groupBy("_slot").agg(F.min(row).alias("m")).collect()}
    above, following = [], top[order]
    for i in reversed(range(slots)):
        above.append(following)
        following = first[i][order] if first.get(i) is not None else following
    # from above; a draw exactly on a total belongs to the next row, and of equal totals the first row counts
    down = W.partitionBy("_slot").orderBy(F.desc("_x"), "_is_row", F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    near = F.last(row, ignorenulls=True).over(down)[order]
    behind = F.element_at(F.array(*[F.lit(x).cast(kind) for x in reversed(above)]), F.col("_slot") + 1)
    hit = line.withColumn("_near", near).withColumn("_behind", behind).where(~F.col("_is_row"))
    return hit.select(F.col(order).alias("draw"), F.coalesce("_near", "_behind").alias(order))


def sample_for_review(df: DataFrame, text: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n samples in a seeded order of their input text, chosen by their number in it."""
    return number_by_hash(df, [text, key], seed, "_rn").where(F.col("_rn") <= n).drop("_rn")


def sort_by_score(df: DataFrame, step: int | None = None, descending: bool = True, scores: Sequence[str] = ("score", "score_1")) -> DataFrame:
    """Samples of a step ordered by the first score column that is set, else 0; adds ``sort_score``."""
    have = [F.col(c) for c in scores if c in df.columns]
    d = df if step is None else df.where(F.col("step") == step)
    d = d.withColumn("sort_score", F.coalesce(*have, F.lit(0.0)))
    return d.orderBy(F.desc("sort_score") if descending else F.asc("sort_score"))


def append_generated(df: DataFrame, new: DataFrame, max_len: int, length: Column | None = None) -> DataFrame:
    """Rows made after a batch join the dataset once they pass its length filter."""
    from .filters import filter_overlong_prompts

    return df.unionByName(filter_overlong_prompts(new, max_len, length), allowMissingColumns=True)
