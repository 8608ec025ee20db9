"""Policy and value loss statistics as table aggregates (no gradients).

Input is the token table with ``old_logp``, ``logp`` (current policy),
``advantage`` and ``mask``.  Every function returns one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import clamp, col, hash_order
from ..functions.groups import number_by_hash
from ..functions.select import among_first
from ..session import cut
from .advantages import EPS, masked_mean
from .offpolicy import Rule, rollout_correction, to_long

LOSS_MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def _on(x: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.col("mask") == 1, x)), F.lit(0.0))


def agg_loss(df: DataFrame, loss: str | Column, mode: str = "token-mean", scale: float | None = None, **shares: Column) -> DataFrame:
    """One row: ``loss`` aggregated by ``mode``, and the masked mean of every named share.

    ``scale`` is the fixed length of ``seq-mean-token-sum-norm``; without it the
    longest row of the table counts, as a padded batch would.
    """
    if mode not in LOSS_MODES:
        raise ValueError(f"unknown loss mode {mode!r}")
    loss = col(loss)
    n = F.sum("mask")
    if mode == "token-mean":
        return df.agg((_on(loss) / n).alias("loss"), *[masked_mean(c).alias(k) for k, c in shares.items()])
    per = df.groupBy("traj_id").agg(
        n.alias("_n"), _on(loss).alias("_l"), F.max("t").alias("_w"), *[_on(c).alias(f"_x_{k}") for k, c in shares.items()]
    )
    some = F.col("_n") > 0
    rows = F.count(F.when(some, 1))
    total = {
        "seq-mean-token-sum": F.sum("_l") / rows,
        "seq-mean-token-mean": F.sum(F.when(some, F.col("_l") / (F.col("_n") + EPS))) / rows,
        "seq-mean-token-sum-norm": F.sum("_l") / (F.lit(float(scale)) if scale else F.max("_w")),
    }[mode]
    return per.agg(total.alias("loss"), *[(F.sum(f"_x_{k}") / (F.sum("_n") + EPS)).alias(k) for k in shares])


def entropy_agg(df: DataFrame, entropy: str = "entropy", mode: str = "token-mean") -> DataFrame:
    return agg_loss(df, entropy, mode)


def _weighted(loss: Column, is_weight: str | None) -> Column:
    return loss * F.col(is_weight) if is_weight else loss


def _ind(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def _ratio(old: str = "old_logp") -> tuple[Column, Column]:
    d = clamp(F.col("logp") - F.col(old), -20.0, 20.0)
    return d, F.exp(d)


def _band(low: float, high: float | None) -> tuple[float, float]:
    return 1.0 - low, 1.0 + (low if high is None else high)


def ppo_clip_stats(df, clip_low=0.2, clip_high=None, dual_clip=3.0, mode="token-mean", is_weight=None, old="old_logp") -> DataFrame:
    """Clipped objective with the dual bound for negative advantages, and its clip shares."""
    if dual_clip <= 1.0:
        raise ValueError("dual_clip must be above 1")
    d, ratio = _ratio(old)
    a = F.col("advantage")
    plain, cut = -a * ratio, -a * clamp(ratio, *_band(clip_low, clip_high))
    upper, floor_ = F.greatest(plain, cut), -a * dual_clip
    loss = F.when(a < 0, F.least(floor_, upper)).otherwise(upper)
    return agg_loss(
        df, _weighted(loss, is_weight), mode,
        clipfrac=_ind(cut > plain), kl=-d, clipfrac_lower=_ind((upper > floor_) & (a < 0)),
    )


def gspo_stats(df, clip_low=0.2, clip_high=None, is_weight=None) -> DataFrame:
    """Length-normalised sequence ratio, clipped, averaged per sequence."""
    seq = W.partitionBy("traj_id")
    d = F.col("logp") - F.col("old_logp")
    mean = F.coalesce(F.sum(F.when(F.col("mask") == 1, d)).over(seq), F.lit(0.0)) / F.greatest(F.sum("mask").over(seq), F.lit(1))
    df = df.withColumn("_r", F.exp(clamp(mean, high=10.0)))
    a, r = F.col("advantage"), F.col("_r")
    plain, cut = -a * r, -a * clamp(r, *_band(clip_low, clip_high))
    return agg_loss(
        df, _weighted(F.greatest(plain, cut), is_weight), "seq-mean-token-mean", clipfrac=_ind(cut > plain), kl=-d
    )


def sapo_stats(df, tau_pos=1.0, tau_neg=1.05, is_weight=None) -> DataFrame:
    """Soft gate 4/tau * sigmoid(tau (ratio - 1)) with tau by the advantage's sign."""
    d, ratio = _ratio()
    a = F.col("advantage")
    tau = F.when(a > 0, F.lit(float(tau_pos))).otherwise(F.lit(float(tau_neg)))
    gate = 4.0 / tau / (1.0 + F.exp(-tau * (ratio - 1.0)))
    return agg_loss(df, _weighted(-gate * a, is_weight), "seq-mean-token-mean", kl=-d)


def gpg_stats(df, mode="token-mean", is_weight=None) -> DataFrame:
    return agg_loss(df, _weighted(-F.col("logp") * F.col("advantage"), is_weight), mode)


def reinforce_stats(df, mode="token-mean", is_weight=None) -> DataFrame:
    """-A log p (times weight); the KL is to the rollout policy."""
    loss = _weighted(-F.col("advantage") * F.col("logp"), is_weight)
    return agg_loss(df, loss, mode, kl=F.col("rollout_logp") - F.col("logp"))


def bypass_stats(
    df: DataFrame, loss_type="ppo_clip", level=None, threshold=2.0, normalize=False,
    rules: list[Rule] | None = None, mode="token-mean", **clip,
) -> DataFrame:
    """Rejection and weights against the rollout policy, then the named loss; long ``(name, value)``.

    The clipped loss leaves the weights out, since its ratio already is the
    ratio to the rollout policy.
    """
    fixed, metrics = rollout_correction(df, level, threshold, normalize, rules, logp="logp")
    if loss_type == "reinforce":
        row = reinforce_stats(fixed, mode, "is_weight" if level else None)
    elif loss_type == "ppo_clip":
        row = ppo_clip_stats(fixed, mode=mode, old="rollout_logp", **clip)
    else:
        raise ValueError(f"unknown loss type {loss_type!r}")
    return to_long(row, "actor/").unionByName(metrics)


def _narrow(df: DataFrame, is_weight: str | None) -> DataFrame:
    """The columns a covariance loss reads, written once: its steps read them several times."""
    return cut(df.select("traj_id", "t", "mask", "logp", "old_logp", "advantage", *([is_weight] if is_weight else [])))


def _hash_parts(*cols: str, seed=0) -> dict[str, Column]:
    """A seeded hash order as numbers that doubles hold exactly, the leading digits first."""
    h = hash_order(*cols, seed=seed)
    return {f"_h{i}": F.conv(F.substring(h, 13 * i - 12, 13), 16, 10).cast("double") for i in (1, 2, 3)}


def _centred_cov(df: DataFrame) -> tuple[DataFrame, Column]:
    m = df.agg(F.struct(masked_mean("advantage").alias("a"), masked_mean("logp").alias("l"))).scalar()
    df = df.withColumn("_c", m)
    return df, (F.col("advantage") - F.col("_c.a")) * (F.col("logp") - F.col("_c.l"))


def clip_cov_stats(
    df, ratio=0.0002, cov_low=1.0, cov_high=5.0, clip_low=0.2, clip_high=None, mode="token-mean", is_weight=None, seed=0
) -> DataFrame:
    """Drop a random few of the tokens whose advantage-logp covariance lies inside the bounds.

    "Random" is a reproducible hash order; the tokens are numbered in it
    without sorting them in one task.
    """
    if ratio <= 0:
        raise ValueError("ratio must be positive")
    df, cov = _centred_cov(_narrow(df, is_weight))
    d = F.col("logp") - F.col("old_logp")
    r, a = F.exp(d), F.col("advantage")
    plain, cut = -a * r, -a * clamp(r, *_band(clip_low, clip_high))
    df = df.withColumn("_cov", cov).drop("_c")
    inside = (F.col("mask") == 1) & ~(cut > plain) & (F.col("_cov") > cov_low) & (F.col("_cov") < cov_high)
    picks = df.agg(F.greatest(F.floor(F.sum("mask") * ratio), F.lit(1))).scalar()
    chosen = number_by_hash(df.where(inside).select("traj_id", "t"), ["traj_id", "t"], seed).where(F.col("rn") <= picks)
    df = df.join(chosen.select("traj_id", "t", F.lit(0.0).alias("_z")), ["traj_id", "t"], "left")
    keep = F.coalesce(F.col("_z"), F.lit(1.0))
    return agg_loss(df, _weighted(F.greatest(plain, cut) * keep, is_weight), mode, clipfrac=1.0 - keep, kl=-d)


def kl_cov_stats(df, ratio=0.0002, kl_coef=1.0, mode="token-mean", is_weight=None, seed=0) -> DataFrame:
    """The tokens with the largest covariance carry a KL term.

    The cut-off covariance is found by refining counts, and among tokens that
    tie with it so is the cut-off of their hash order.
    """
    df, cov = _centred_cov(_narrow(df.where("mask = 1"), is_weight))
    df = df.withColumn("_rank", -cov).drop("_c")
    df = cut(df.withColumns(_hash_parts("traj_id", "t", seed=seed)))
    picks = max(1, int(df.count() * ratio))
    large = F.when(among_first(df, ["_rank", "_h1", "_h2", "_h3"], picks), 1.0).otherwise(0.0)
    d = F.col("logp") - F.col("old_logp")
    loss = -F.col("advantage") * F.exp(d) + kl_coef * F.abs(d) * large
    return agg_loss(df, _weighted(loss, is_weight), mode, kl=F.abs(d))


def geo_mean_stats(df, clip_low=0.2, clip_high=None, is_weight=None) -> DataFrame:
    """Geometric-mean ratio per rollout, with the log ratio cut on the side the advantage allows."""
    high = clip_low if clip_high is None else clip_high
    d, a = F.col("logp") - F.col("old_logp"), F.col("advantage")
    cut = clamp(d, -clip_low, high)
    side = F.signum(a)
    kept = side * F.least(side * d, side * cut)
    per = df.groupBy("traj_id").agg(
        F.sum("mask").alias("n"), _on(kept).alias("k"), _on(a).alias("a"), _on(-d).alias("kl"),
        _on(_ind((d != cut) & (a > 0))).alias("hi"), _on(_ind((d != cut) & (a < 0))).alias("lo"),
        (_on(F.log(F.col(is_weight) + 1e-10)) if is_weight else F.lit(0.0)).alias("w"),
    )
    n = F.col("n") + EPS
    loss = -F.col("a") / n * F.exp(F.col("k") / n) * F.exp(F.col("w") / n)
    total = F.sum("n") + EPS
    return per.agg(
        F.avg(loss).alias("loss"), (F.sum("hi") / total).alias("clipfrac"),
        (F.sum("kl") / total).alias("kl"), (F.sum("lo") / total).alias("clipfrac_lower"),
    )


def cispo_stats(df, clip_low=0.2, clip_high=None, mode="token-mean", is_weight=None) -> DataFrame:
    """-clip(ratio) A log p."""
    d, ratio = _ratio()
    cut = clamp(ratio, *_band(clip_low, clip_high))
    loss = -cut * F.col("advantage") * F.col("logp")
    return agg_loss(df, _weighted(loss, is_weight), mode, clipfrac=_ind(ratio != cut), kl=-d)


def value_loss_stats(df, prediction="vpred", value="value", returns="return", clip=0.5, mode="token-mean") -> DataFrame:
    """Half the larger of the plain and the clipped squared value error."""
    v, r, p = F.col(value), F.col(returns), F.col(prediction)
    cut = F.greatest(F.least(p, v + clip), v - clip)
    e1, e2 = (p - r) * (p - r), (cut - r) * (cut - r)
    return agg_loss(df, 0.5 * F.greatest(e1, e2), mode, clipfrac=_ind(e2 > e1))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _log_sum_exp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.log(_sum(F.transform(a, lambda x: F.exp(x - top))))


def topk_divergence(
    df, student="student_topk", teacher="teacher_topk", alpha=1.0, add_tail=True,
    is_clip: float | None = None, is_weight: str | None = None, out="divergence",
) -> DataFrame:
    """Per-token divergence of two stored top-k log-prob arrays.

    ``alpha`` 0 is forward KL, 1 reverse KL, between them the generalised
    Jensen-Shannon divergence.  The arrays get one bucket for the missing mass,
    or are renormalised.
    """

    def whole(a: Column) -> Column:
        z = _log_sum_exp(a)
        if not add_tail:
            return F.transform(a, lambda x: x - z)
        z = F.least(z, F.lit(-1e-7))
        return F.concat(a, F.array(F.log(-F.expm1(z))))

    df = df.withColumn("_s", whole(F.col(student))).withColumn("_t", whole(F.col(teacher)))

    def kl(p: Column, q: Column) -> Column:
        return _sum(F.zip_with(p, q, lambda x, y: F.exp(x) * (x - y)))

    s, t = F.col("_s"), F.col("_t")
    if alpha == 0.0:
        d = kl(t, s)
    elif alpha == 1.0:
        d = kl(s, t)
    else:
        mix = F.zip_with(s, t, lambda x, y: F.log((1 - alpha) * F.exp(x) + alpha * F.exp(y)))
        df = df.withColumn("_mix", mix)
        d = (1 - alpha) * kl(s, F.col("_mix")) + alpha * kl(t, F.col("_mix"))
    if is_clip is not None:
        d = d * clamp(F.exp(clamp(F.col("logp") - F.col("old_logp"), -20.0, 20.0)), high=is_clip)
    return df.withColumn(out, _weighted(d, is_weight)).drop("_s", "_t", "_mix")


def sampled_divergence(df, student="logp", teacher="teacher_logp", out="divergence") -> DataFrame:
    """Reverse KL from the sampled token alone: log ratio times the student's log-prob."""
    return df.withColumn(out, (F.col(student) - F.col(teacher)) * F.col(student))


def distillation_loss(df, divergence="divergence", use: str | None = None, mode="token-mean") -> DataFrame:
    """Aggregate a divergence; ``use`` names a per-row 0/1 flag that narrows the mask; no valid token gives 0."""
    if use:
        df = df.withColumn("mask", F.col("mask") * F.col(use).cast("int"))
    if mode == "token-mean":
        return df.agg((_on(F.col(divergence)) / F.greatest(F.sum("mask"), F.lit(1))).alias("loss"))
    return agg_loss(df, divergence, mode)


# ---------------------------------------------------------------- registry
LOSS_STATS: dict[str, Callable[..., DataFrame]] = {}


def register_loss_stat(name: str, fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Name a loss; a later registration replaces an earlier one."""
    LOSS_STATS[name] = fn
    return fn


def get_loss_stat(name: str) -> Callable[..., DataFrame]:
    if name not in LOSS_STATS:
        raise ValueError(f"unknown loss {name!r}; choose from {sorted(LOSS_STATS)}")
    return LOSS_STATS[name]


# fixed names of the losses
for _name, _fn in (
    ("vanilla", ppo_clip_stats),
    ("gspo", gspo_stats),
    ("sapo", sapo_stats),
    ("gpg", gpg_stats),
    ("clip_cov", clip_cov_stats),
    ("kl_cov", kl_cov_stats),
    ("geo_mean", geo_mean_stats),
    ("cispo", cispo_stats),
    ("bypass_mode", bypass_stats),
):
    register_loss_stat(_name, _fn)
