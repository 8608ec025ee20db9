"""Validation statistics: mean, std, best, worst and majority at n, per source.

Samples are long rows ``data_source, uid, var, value``.  Everything is grouped
aggregation; a prompt group of any size is spread by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.groups import attach_group_stats, cumulative_by_value
from ..session import cut

GROUP = ["data_source", "uid", "var"]
#: Shares of wins that a task keeps for groups of equal counts, as numbers.
KEPT_SHARES = 1 << 22


def melt_vars(rollouts: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Numeric columns of the rollouts as long rows."""
    pairs = [F.struct(F.lit(v).alias("var"), F.col(v).cast("double").alias("value")) for v in variables]
    return rollouts.select("data_source", "uid", F.inline(F.array(*pairs)))


def _over_prompts(per_prompt: DataFrame) -> DataFrame:
    return per_prompt.groupBy("data_source", "var", "metric").agg(F.avg("value").alias("value"))


def _named(*pairs: tuple[Column, Column]) -> Column:
    items = F.array(*[F.struct(n.alias("metric"), v.alias("value")) for n, v in pairs])
    return F.inline(F.filter(items, lambda x: x["value"].isNotNull()))


def subset_sizes(n: Column) -> Column:
    """2, 4, 8, ... below n, and n itself; empty for n <= 1."""
    powers = F.transform(F.sequence(F.lit(1), F.lit(52)), lambda i: F.pow(F.lit(2.0), i.cast("double")).cast("long"))
    powers = F.filter(powers, lambda p: p < n)
    return F.when(n > 1, F.array_append(powers, n.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def mean_std_at_n(samples: DataFrame) -> DataFrame:
    """mean@N and (for N > 1) population std@N per prompt, averaged over the prompts of a source."""
    g = samples.groupBy(*GROUP).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("string")
    rows = g.select(
        "data_source", "var",
        _named(
            (F.concat(F.lit("mean@"), n), F.col("m")),
            (F.concat(F.lit("std@"), n), F.when(F.col("n") > 1, F.col("s"))),
        ),
    )
    return _over_prompts(rows)


validation_metrics = mean_std_at_n


def best_worst_at_n(samples: DataFrame) -> DataFrame:
    """Exact mean and std of the best and the worst of n draws with replacement, n = 2, 4, 8, ..., N.

    With C the running count up to a value and c its own count, the best of n
    draws equals the value with probability (C/N)^n - ((C-c)/N)^n; the worst
    mirrors it.  These are the limits of the resampled estimates.  The counts,
    which several steps read, are written once.
    """
    return _best_worst(cut(value_counts(samples)))


def _best_worst(counts: DataFrame) -> DataFrame:
    upto = cumulative_by_value(counts, GROUP, "value", "c", "upto")
    size = counts.groupBy(*GROUP).agg(F.sum("c").alias("size")).where("size > 1")
    d = upto.join(size, GROUP).withColumn("n", F.explode(subset_sizes(F.col("size"))))
    share = lambda k: F.pow(k / F.col("size"), F.col("n"))
    above = F.col("size") - F.col("upto")
    best = share(F.col("upto")) - share(F.col("upto") - F.col("c"))
    worst = share(above + F.col("c")) - share(above)
    v = F.col("value")
    g = d.groupBy(*GROUP, "n").agg(
        F.sum(best * v).alias("bm"), F.sum(best * v * v).alias("b2"),
        F.sum(worst * v).alias("wm"), F.sum(worst * v * v).alias("w2"),
    )
    std = lambda m, q: F.sqrt(F.greatest(F.col(q) - F.col(m) * F.col(m), F.lit(0.0)))
    name = lambda kind, stat: F.concat(F.lit(f"{kind}@"), F.col("n").cast("string"), F.lit(f"/{stat}"))
    rows = g.select(
        "data_source", "var",
        _named(
            (name("best", "mean"), F.col("bm")), (name("best", "std"), std("bm", "b2")),
            (name("worst", "mean"), F.col("wm")), (name("worst", "std"), std("wm", "w2")),
        ),
    )
    return _over_prompts(rows)


def majority_vote(votes: DataFrame, keys: Sequence[str] = ("data_source", "uid")) -> DataFrame:
    """Value of the first sample of the most frequent ``pred``; ties go to the pred seen first (``order``)."""
    keys = list(keys)
    by_pred = votes.groupBy(*keys, "pred").agg(
        F.count(F.lit(1)).alias("_n"), F.min("order").alias("_first"), F.min_by("value", "order").alias("_v")
    )
    # the least (-count, first) leads, whatever the type of the order
    return by_pred.groupBy(*keys).agg(F.min_by("_v", F.struct((-F.col("_n")).alias("n"), "_first")).alias("value"))


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniforms(n: int, n_boot: int, i: int, seed: int) -> np.ndarray:
    """The i-th number of every repeat of n draws: a hash of counters, the same everywhere."""
    step = np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    key = _spread((np.uint64(seed) << np.uint64(48)) + (np.uint64(n) << np.uint64(20)) + np.arange(n_boot, dtype=np.uint64))
    return ((_spread(key + step) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def _log_factorial(x: np.ndarray) -> np.ndarray:
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, 64.0)))])
    y = np.maximum(x, 16.0) + 1.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(x < 64, small[np.clip(x, 0, 63).astype(np.int64)], series)


def _binomial(draws: np.ndarray, share: float, unit: np.ndarray) -> np.ndarray:
    """The least count whose cumulative binomial probability exceeds ``unit``, for each number of draws.

    Sums run over twelve standard deviations to either side; what lies beyond
    is less than a double can hold beside 1.
    """
    if share >= 1:
        return draws.copy()
    sizes, row = np.unique(draws, return_inverse=True)
    spread = 12 * np.sqrt(sizes * share * (1 - share)) + 12
    low = np.maximum(0, np.floor(sizes * share - spread))
    width = int(min(sizes.max(), np.ceil(2 * spread.max() + 1))) + 1
    k = low[:, None] + np.arange(width)
    left = sizes[:, None] - k
    log = _log_factorial(sizes.astype(float))[:, None] - _log_factorial(k) - _log_factorial(np.maximum(left, 0)) + k * np.log(share) + left * np.log1p(-share)
    upto = np.cumsum(np.where(left >= 0, np.exp(np.where(left >= 0, log, -np.inf)), 0.0), axis=1)
    found = low[row].astype(np.int64) + (upto[row] <= unit[:, None]).sum(1)
    return np.minimum(found, draws)


def majority_shares(counts: Sequence[int], n: int, n_boot: int, seed: int) -> np.ndarray:
    """How often each pred wins the vote of ``n`` draws with replacement, from ``n_boot`` repeats.

    ``counts`` are the preds' counts in falling order.  Draws per pred follow
    from conditional binomials, one uniform number each, so the cost is per
    pred and not per draw; it ends where no later pred can win any more.  Tied
    preds share a win: which of them is drawn first is equally likely.
    """
    left, rest = np.full(n_boot, n, dtype=np.int64), sum(counts)
    drawn: list[np.ndarray] = []
    most = np.zeros(n_boot, dtype=np.int64)
    for i, c in enumerate(counts):
        if (left < most).all():
            break
        drawn.append(_binomial(left, c / rest, _uniforms(n, n_boot, i, seed)))
        left, rest, most = left - drawn[-1], rest - c, np.maximum(most, drawn[-1])
    wins = np.stack(drawn) == most
    shares = np.zeros(len(counts))
    shares[: len(drawn)] = (wins / wins.sum(0)).mean(1)
    return shares


def _votes(n_boot: int, seed: int):
    """Rows of whole prompt groups (counts and sums per pred) to mean and std of the vote's value per subset size."""

    def run(batches):
        kept: dict[tuple, np.ndarray] = {}
        held = 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                preds = row["preds"]
                counts = tuple(-p["minus"] for p in preds)
                size = sum(counts)
                known, total, square = (np.array([p[c] for p in preds], dtype=float) / counts for c in ("known", "s", "q"))
                for n in sorted({1 << b for b in range(1, 53) if 1 << b < size} | {size}):
                    shares = kept.get((counts, n))
                    if shares is None:
                        shares = majority_shares(counts, n, n_boot, seed)
                        if held + len(counts) <= KEPT_SHARES:
                            kept[counts, n] = shares
                            held += len(counts)
                    real = float(shares @ known)
                    if real > 0:
                        mean = float(shares @ total) / real
                        out.append((row["data_source"], row["var"], n, mean, max(0.0, float(shares @ square) / real - mean * mean) ** 0.5))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=["data_source", "var", "n", "m", "s"])

    return run


def majority_at_n(votes: DataFrame, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """``maj_at_n`` from votes counted by ``vote_counts``, merged or not."""
    pred = F.struct((-F.col("n")).alias("minus"), "pred", "known", "s", "q")
    prompts = votes.groupBy(*GROUP).agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(pred)).alias("preds")).where("size > 1")
    g = prompts.select("data_source", "var", "preds").mapInArrow(_votes(n_boot, seed), "data_source string, var string, n long, m double, s double")
    n = F.col("n").cast("string")
    rows = g.select(
        "data_source", "var",
        _named(
            (F.concat(F.lit("maj@"), n, F.lit("/mean")), F.col("m")),
            (F.concat(F.lit("maj@"), n, F.lit("/std")), F.col("s")),
        ),
    )
    return _over_prompts(rows)


def maj_at_n(rollouts: DataFrame, value: str | Sequence[str], n_boot: int = 1000, seed: int = 42, order: str = "traj_id") -> DataFrame:
    """Resampled majority vote: mean and std of the vote over draws of n rollouts, n = 2, 4, 8, ..., N, for every ``value``.

    A vote shows the value of the first drawn rollout of its most frequent pred
    (ties: the pred drawn first).  ``n_boot`` repeats tell how often each pred
    wins; which of a pred's rollouts comes first is equally likely for all of
    them, so the pred's own mean and mean square stand for the value.  Rollouts
    without a value are left out where they come first.

    Rollouts are counted by pred before the shuffle.  A task holds one prompt's
    distinct preds, a number each, whatever the number of its rollouts.
    """
    return majority_at_n(vote_counts(rollouts, [value] if isinstance(value, str) else list(value), order), n_boot, seed)


def maj_full_vote(rollouts: DataFrame, value: str, order: str = "traj_id") -> DataFrame:
    """Majority vote over all N rollouts of each prompt, averaged per source and N."""
    return full_vote(vote_counts(rollouts, [value], order))


def validation_report(metrics: DataFrame, fallback: str = "reward") -> DataFrame:
    """Names of logged metrics: ``val-core`` for mean, maj and best of the core variable at the largest n.

    The core variable is ``acc`` where a source has it, else ``fallback``.
    """
    n = F.regexp_extract("metric", r"@(\d+)", 1).cast("long")
    m = metrics.withColumn("_n", n)
    top = m.groupBy("data_source", "var").agg(F.max("_n").alias("_top"))
    core = metrics.groupBy("data_source").agg(
        F.when(F.max(F.when(F.col("var") == "acc", 1)) == 1, "acc").otherwise(fallback).alias("_core")
    )
    m = m.join(top, ["data_source", "var"]).join(core, "data_source")
    is_core = (F.col("var") == F.col("_core")) & F.col("metric").rlike("^(mean|maj|best)") & (F.col("_n") == F.col("_top"))
    name = F.concat_ws("/", F.when(is_core, "val-core").otherwise("val-aux"), "data_source", "var", "metric")
    return m.select(name.alias("name"), "value")


def validation_extras(rollouts: DataFrame) -> DataFrame:
    """Turn counts, token counts and teacher accuracy of a validation run, where the columns exist."""
    # fixed names of the extra metrics
    named = {
        "num_turns": [("val-aux/num_turns/min", F.min), ("val-aux/num_turns/max", F.max), ("val-aux/num_turns/mean", F.avg)],
        "teacher_acc": [("val-aux/self_distillation/teacher_acc_mean", F.avg)],
        "teacher_acc_reprompted": [("val-aux/self_distillation/teacher_acc_reprompted_mean", F.avg)],
        "num_generated_tokens": [("val-aux/generation/num_generated_tokens_mean", F.avg)],
        "teacher_num_generated_tokens": [("val-aux/self_distillation/teacher_num_generated_tokens_mean", F.avg)],
    }
    from .offpolicy import to_long

    aggs = [fn(c).cast("double").alias(n) for c, ns in named.items() if c in rollouts.columns for n, fn in ns]
    return to_long(rollouts.agg(*aggs)).where("value is not null")


def merge_validation(a: DataFrame, b: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Report over two result sets; a column one of them lacks is empty there."""
    both = a.unionByName(b, allowMissingColumns=True)
    samples = melt_vars(both, variables).where(F.col("value").isNotNull())
    return validation_report(mean_std_at_n(samples).unionByName(best_worst_at_n(samples)))


def eval_by_source(scored: DataFrame, score: str = "score") -> DataFrame:
    """Mean over the responses of a prompt, then over the prompts of a source."""
    per = scored.groupBy("data_source", "uid").agg(F.avg(score).alias("s"))
    return per.groupBy("data_source").agg(F.avg("s").alias("value")).select(
        F.concat(F.lit("test_score/"), "data_source").alias("name"), "value"
    )


def explode_responses(prompts: DataFrame, responses: str = "responses") -> DataFrame:
    """One row per response of an offline generation table."""
    return prompts.select("*", F.posexplode(responses).alias("response_idx", "response")).drop(responses)


# ---------------------------------------------------------------- late results
def value_counts(samples: DataFrame) -> DataFrame:
    """Mergeable histogram of a prompt's values: ``data_source, uid, var, value, c``."""
    return samples.groupBy(*GROUP, "value").agg(F.count(F.lit(1)).alias("c"))


def vote_counts(rollouts: DataFrame, variables: Sequence[str], order: str = "traj_id") -> DataFrame:
    """Mergeable votes of a prompt: per variable and pred, how many (``n``), the first one's place and value, and the values' number, sum and squares."""
    pairs = [F.struct(F.lit(v).alias("var"), F.col(v).cast("double").alias("value")) for v in variables]
    rows = rollouts.select("data_source", "uid", F.col("pred").cast("string").alias("pred"), F.col(order).alias("first"), F.inline(F.array(*pairs)))
    v = F.col("value")
    return rows.groupBy(*GROUP, "pred").agg(
        F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.min_by(F.struct("value"), "first")["value"].alias("head"),
        F.count(v).alias("known"), F.coalesce(F.sum(v), F.lit(0.0)).alias("s"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("q"),
    )


def merge_value_counts(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy(*GROUP, "value").agg(F.sum("c").alias("c"))


def merge_vote_counts(*parts: DataFrame) -> DataFrame:
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(*GROUP, "pred").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.min_by(F.struct("head"), "first")["head"].alias("head"),
        F.sum("known").alias("known"), F.sum("s").alias("s"), F.sum("q").alias("q"),
    )


def full_vote(votes: DataFrame) -> DataFrame:
    """Majority vote over all rollouts of each prompt, from counted votes; ties go to the pred seen first."""
    lead = F.min_by(F.struct("head"), F.struct((-F.col("n")).alias("minus"), "first"))["head"].alias("value")
    per = votes.groupBy(*GROUP).agg(F.sum("n").alias("size"), lead)
    return _over_prompts(per.select("data_source", "var", F.concat(F.lit("maj@"), F.col("size").cast("string"), F.lit("/vote")).alias("metric"), "value"))


def _mean_std(counts: DataFrame) -> DataFrame:
    c, v = F.col("c"), F.col("value")
    mean = (F.sum(c * v) / F.sum(F.when(v.isNotNull(), c))).alias("_m")
    d = attach_group_stats(counts, GROUP, [mean])
    g = d.groupBy(*GROUP).agg(
        F.first("_m").alias("m"), F.sqrt(F.sum(c * (v - F.col("_m")) * (v - F.col("_m"))) / F.sum(F.when(v.isNotNull(), c))).alias("s"), F.sum(c).alias("n")
    )
    n = F.col("n").cast("string")
    return _over_prompts(g.select("data_source", "var", _named(
        (F.concat(F.lit("mean@"), n), F.col("m")), (F.concat(F.lit("std@"), n), F.when(F.col("n") > 1, F.col("s"))))))


def counts_to_metrics(values: DataFrame, votes: DataFrame | None = None, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """All validation metrics (mean, std, best, worst and, with votes, majority at n) from counted values and votes.

    Counts of parts add up, so late or resumed results give the metrics of one
    run over everything, in whatever parts and order they came.  The values,
    which several steps read, are written once.
    """
    values = cut(values)
    metrics = _mean_std(values).unionByName(_best_worst(values))
    return metrics if votes is None else metrics.unionByName(majority_at_n(votes, n_boot, seed))


def validation_partials(samples: DataFrame) -> DataFrame:
    """Mergeable (n, sum, sum of squares) per prompt and variable."""
    v = F.col("value")
    return samples.groupBy(*GROUP).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))


def merge_partials(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*GROUP).agg(F.sum("n").cast("long").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def partials_to_metrics(partials: DataFrame) -> DataFrame:
    """mean@N and std@N from merged partials; equals a run over all samples at once."""
    m = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - m * m, F.lit(0.0)))
    n = F.col("n").cast("string")
    rows = partials.select(
        "data_source", "var",
        _named((F.concat(F.lit("mean@"), n), m), (F.concat(F.lit("std@"), n), F.when(F.col("n") > 1, sd))),
    )
    return _over_prompts(rows)
