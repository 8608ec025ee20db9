"""Importance weights, rejection masks and off-policy diagnostics over the token table.

Sequence numbers are windows or aggregates by ``traj_id`` (one response, bounded
by the model's context); table numbers are one aggregate, put back as a scalar
subquery.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import clamp, col
from .advantages import EPS, masked_mean

# fixed values: bound of log ratios before exp, and the names of the rejection rules
SAFE_LOG = 20.0
REJECTION_RULES = (
    "token_k1", "token_k2", "token_k3",
    "seq_sum_k1", "seq_sum_k2", "seq_sum_k3",
    "seq_mean_k1", "seq_mean_k2", "seq_mean_k3",
    "seq_max_k2", "seq_max_k3",
)


def log_ratio(logp: str = "old_logp", rollout_logp: str = "rollout_logp") -> Column:
    return F.col(logp) - F.col(rollout_logp)


def _m(x: Column) -> Column:
    return F.when(F.col("mask") == 1, x)


def _frac(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def bypass_logprobs(tokens: DataFrame) -> DataFrame:
    """Take the rollout policy's log-probs as the old ones."""
    return tokens.withColumn("old_logp", F.col("rollout_logp"))


# ---------------------------------------------------------------- importance weights
def _raw_weights(tokens: DataFrame, level: str, logp: str, rollout_logp: str) -> DataFrame:
    """Adds ``_lr`` (the log ratio the weight comes from) and ``is_weight`` before the cap."""
    lr = log_ratio(logp, rollout_logp)
    if level == "sequence":
        lr = F.coalesce(F.sum(_m(lr)).over(W.partitionBy("traj_id")), F.lit(0.0))
    elif level != "token":
        raise ValueError(f"level must be token or sequence, got {level!r}")
    d = tokens.withColumn("_lr", lr)
    w = F.exp(clamp("_lr", -SAFE_LOG, SAFE_LOG))
    return d.withColumn("is_weight", F.when(F.col("mask") == 1, w).otherwise(0.0))


def _mean_weight(weighted: DataFrame, level: str) -> DataFrame:
    if level == "token":
        return weighted.agg(masked_mean("is_weight").alias("m"))
    per = weighted.groupBy("traj_id").agg(masked_mean("is_weight").alias("w"), F.max("mask").alias("has"))
    return per.agg((F.sum(F.col("w") * F.col("has")) / F.greatest(F.sum("has").cast("double"), F.lit(1e-8))).alias("m"))


def is_weights(
    tokens: DataFrame,
    level: str = "token",
    threshold: float = 2.0,
    normalize: bool = False,
    logp: str = "old_logp",
    rollout_logp: str = "rollout_logp",
) -> DataFrame:
    """Adds ``is_weight``: exp(log ratio) per token or per sequence, times mask, capped at ``threshold``.

    ``normalize`` divides by the mean weight of the table.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    d = _raw_weights(tokens, level, logp, rollout_logp).drop("_lr")
    d = d.withColumn("is_weight", clamp("is_weight", high=threshold))
    if normalize:
        m = _mean_weight(d, level).scalar()
        d = d.withColumn("is_weight", F.when(m > 1e-8, F.col("is_weight") / m).otherwise(F.col("is_weight")))
    return d


def is_metrics(
    tokens: DataFrame,
    level: str = "token",
    threshold: float = 2.0,
    logp: str = "old_logp",
    rollout_logp: str = "rollout_logp",
) -> DataFrame:
    """One row of weight statistics, taken before the cap."""
    d = _raw_weights(tokens, level, logp, rollout_logp)
    low, up = 1.0 / threshold, threshold
    w, c = F.col("is_weight"), clamp("is_weight", low, up)
    per = d.groupBy("traj_id").agg(
        F.sum("mask").alias("n"),
        F.sum(_m(w)).alias("sw"), F.max(_m(w)).alias("xw"), F.min(_m(w)).alias("nw"),
        F.sum(_m(c)).alias("sc"), F.sum(_m(c * c)).alias("scc"),
        F.sum(_m(_frac(w > up))).alias("hi"), F.sum(_m(_frac(w < low))).alias("lo"),
        F.max("_lr").alias("lr"),
    ).withColumn("seq", F.coalesce(F.col("sw"), F.lit(0.0)) / (F.col("n") + EPS))
    n = F.sum("n") + EPS
    mean_c, mean_cc = F.sum("sc") / n, F.sum("scc") / n
    rows = F.count(F.lit(1))
    if level == "sequence":
        span = [
            F.exp(clamp(F.max("lr"), high=SAFE_LOG)).alias("rollout_is_max"),
            F.exp(F.min("lr")).alias("rollout_is_min"),
            F.avg(_frac(F.col("lr") > math.log(up))).alias("rollout_is_ratio_fraction_high"),
            F.avg(_frac(F.col("lr") < math.log(low))).alias("rollout_is_ratio_fraction_low"),
        ]
    else:
        span = [
            F.max("xw").alias("rollout_is_max"),
            F.min("nw").alias("rollout_is_min"),
            (F.sum("hi") / n).alias("rollout_is_ratio_fraction_high"),
            (F.sum("lo") / n).alias("rollout_is_ratio_fraction_low"),
        ]
    norm = mean_c + EPS
    return per.agg(
        (F.sum("sw") / n).alias("rollout_is_mean"),
        *span,
        F.when(F.sum("n") > 1, F.sqrt(F.greatest(mean_cc - mean_c * mean_c, F.lit(0.0)))).otherwise(0.0).alias("rollout_is_std"),
        (1.0 / (mean_cc / (norm * norm))).alias("rollout_is_eff_sample_size"),
        F.avg("seq").alias("rollout_is_seq_mean"),
        F.when(rows > 1, F.stddev_samp("seq")).otherwise(0.0).alias("rollout_is_seq_std"),
        F.max("seq").alias("rollout_is_seq_max"),
        F.min("seq").alias("rollout_is_seq_min"),
        F.max(F.abs(F.col("seq") - 1.0)).alias("rollout_is_seq_max_deviation"),
        F.avg(_frac(F.col("seq") > up)).alias("rollout_is_seq_fraction_high"),
        F.avg(_frac(F.col("seq") < low)).alias("rollout_is_seq_fraction_low"),
    )


def is_norm_factor(tokens: DataFrame, level: str = "token", threshold: float = 2.0, **kw) -> DataFrame:
    """Mean capped weight that ``is_weights(normalize=True)`` divides by (1 when it is about zero)."""
    m = _mean_weight(is_weights(tokens, level, threshold, **kw), level)
    return m.select(F.when(F.col("m") > 1e-8, F.col("m")).otherwise(1.0).alias("rollout_is_batch_norm_factor"))


# ---------------------------------------------------------------- rejection
@dataclass(frozen=True)
class Rule:
    """One rejection rule; k1 rules have bounds on the ratio, the others an upper bound only."""

    name: str
    upper: float
    lower: float | None = None

    def __post_init__(self):
        if self.name not in REJECTION_RULES:
            raise ValueError(f"unknown rejection rule {self.name!r}; choose from {REJECTION_RULES}")
        if self.upper <= 0 or (self.lower is not None and self.lower <= 0):
            raise ValueError("bounds must be positive")
        if self.lower is not None and not self.is_k1:
            raise ValueError(f"{self.name} takes an upper bound only")

    @property
    def is_k1(self) -> bool:
        return self.name.endswith("k1")

    @property
    def per_token(self) -> bool:
        return self.name.startswith("token")

    @property
    def high(self) -> float:
        return math.log(self.upper) if self.is_k1 else self.upper

    @property
    def low(self) -> float | None:
        if not self.is_k1:
            return None
        return math.log(1.0 / self.upper if self.lower is None else self.lower)


def rejection_rules(options: str, thresholds: str | float) -> list[Rule]:
    """Rules from text such as ``"token_k1,seq_mean_k3"`` and ``"0.5_2.0,0.1"``.

    One threshold serves all options; ``low_high`` names both bounds of a k1 rule.
    """
    names = list(dict.fromkeys(o.strip() for o in options.split(",") if o.strip()))
    specs = [p.strip() for p in str(thresholds).split(",") if p.strip()]
    if not names or len(specs) not in (1, len(names)):
        raise ValueError("give one threshold for all rejection rules, or one per rule")
    specs = specs * len(names) if len(specs) == 1 else specs

    def rule(name: str, spec: str) -> Rule:
        low, _, high = spec.rpartition("_")
        return Rule(name, float(high), float(low) if low else None)

    return [rule(n, s) for n, s in zip(names, specs)]


def _statistic(rule: Rule, logp: str, rollout_logp: str) -> Column:
    """Per-token statistic of a rule; sequence rules repeat it on every token of the sequence."""
    lr = clamp(log_ratio(logp, rollout_logp), -SAFE_LOG, SAFE_LOG)
    kind = {"1": -lr, "2": 0.5 * lr * lr, "3": F.exp(lr) - 1.0 - lr}[rule.name[-1]]
    if rule.per_token:
        return kind
    seq = W.partitionBy("traj_id")
    total = F.coalesce(F.sum(_m(kind)).over(seq), F.lit(0.0))
    if rule.name.startswith("seq_sum"):
        return total
    if rule.name.startswith("seq_mean"):
        return total / (F.sum("mask").over(seq) + EPS)
    return F.coalesce(F.max(_m(kind)).over(seq), F.lit(0.0))


def _keep(rule: Rule, stat: Column) -> Column:
    ok = stat <= rule.high
    return ok & (stat >= rule.low) if rule.is_k1 else ok


def _with_statistics(tokens: DataFrame, rules: list[Rule], logp: str, rollout_logp: str) -> DataFrame:
    return tokens.withColumns({f"_s{i}": _statistic(r, logp, rollout_logp) for i, r in enumerate(rules)})


def rejection_mask(
    tokens: DataFrame, rules: list[Rule], logp: str = "old_logp", rollout_logp: str = "rollout_logp"
) -> DataFrame:
    """Zero the mask of every token that fails any rule."""
    d = _with_statistics(tokens, rules, logp, rollout_logp)
    keep = F.lit(True)
    for i, r in enumerate(rules):
        keep = keep & _keep(r, F.col(f"_s{i}"))
    d = d.withColumn("mask", F.when(keep, F.col("mask")).otherwise(0))
    return d.drop(*[f"_s{i}" for i in range(len(rules))])


def rejection_metrics(
    tokens: DataFrame, rules: list[Rule], logp: str = "old_logp", rollout_logp: str = "rollout_logp"
) -> DataFrame:
    """Long table ``(name, value)`` of every rule's statistics and the combined masked shares."""
    d = _with_statistics(tokens, rules, logp, rollout_logp)
    per, out = [F.sum("mask").alias("n")], {}
    all_kept = F.lit(True)
    for i, r in enumerate(rules):
        s = F.col(f"_s{i}")
        c = clamp(s, 0.0 if r.low is None else r.low, r.high)
        keep = _keep(r, s)
        all_kept = all_kept & keep
        per += [
            F.sum(_m(s)).alias(f"s{i}"), F.max(_m(s)).alias(f"x{i}"), F.min(_m(s)).alias(f"m{i}"),
            F.sum(_m(c)).alias(f"c{i}"), F.sum(_m(c * c)).alias(f"cc{i}"),
            F.sum(_m(_frac(s > r.high))).alias(f"h{i}"),
            F.sum(_m(_frac(s < r.low) if r.is_k1 else F.lit(0.0))).alias(f"l{i}"),
            F.sum(_m(_frac(~keep))).alias(f"r{i}"),
        ]
    per.append(F.sum(_m(_frac(~all_kept))).alias("r"))
    seq = d.groupBy("traj_id").agg(*per)
    n = F.sum("n") + EPS
    some = F.col("n") > 0
    for i, r in enumerate(rules):
        p = f"rollout_rs_{r.name}"
        # a sequence rule repeats one number over the sequence, so its maximum is that number
        v = F.when(some, F.col(f"s{i}") / (F.col("n") + EPS) if r.per_token else F.col(f"x{i}"))
        high, low = F.avg(F.when(some, _frac(v > r.high))), F.lit(0.0)
        if r.is_k1:
            low = F.avg(F.when(some, _frac(v < r.low)))
        mc, mcc = F.sum(f"c{i}") / n, F.sum(f"cc{i}") / n
        out[f"{p}_mean"] = F.sum(f"s{i}") / n
        out[f"{p}_max"], out[f"{p}_min"] = F.max(f"x{i}"), F.min(f"m{i}")
        out[f"{p}_fraction_high"] = F.sum(f"h{i}") / n if r.per_token else high
        out[f"{p}_fraction_low"] = F.sum(f"l{i}") / n if r.per_token else low
        out[f"{p}_std"] = F.when(F.sum("n") > 1, F.sqrt(F.greatest(mcc - mc * mc, F.lit(0.0)))).otherwise(0.0)
        out[f"{p}_seq_mean"] = F.avg(v)
        out[f"{p}_seq_std"] = F.when(F.count(v) > 1, F.stddev_samp(v)).otherwise(0.0)
        out[f"{p}_seq_max"], out[f"{p}_seq_min"] = F.max(v), F.min(v)
        out[f"{p}_seq_max_deviation"] = F.max(F.abs(v))
        out[f"{p}_seq_fraction_high"] = high
        if r.is_k1:
            out[f"{p}_seq_fraction_low"] = low
        out[f"{p}_masked_fraction"] = F.sum(f"r{i}") / n
        out[f"{p}_seq_masked_fraction"] = F.avg(F.when(some, _frac(F.col(f"r{i}") > 0)))
    out["rollout_rs_masked_fraction"] = F.sum("r") / n
    out["rollout_rs_seq_masked_fraction"] = F.avg(_frac(F.coalesce(F.col("r"), F.lit(0.0)) > 0))
    return to_long(seq.agg(*[c.cast("double").alias(k) for k, c in out.items()]))


def to_long(wide: DataFrame, prefix: str = "") -> DataFrame:
    """One wide row of metrics as ``(name, value)``."""
    pairs = [F.struct(F.lit(prefix + c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in wide.columns]
    return wide.select(F.inline(F.array(*pairs)))


# ---------------------------------------------------------------- diagnostics
def offpolicy_metrics(tokens: DataFrame, logp: str = "old_logp", rollout_logp: str = "rollout_logp") -> DataFrame:
    """Perplexities of both policies, their KL and chi-square, as one row."""
    lr = log_ratio(logp, rollout_logp)
    rho = F.exp(clamp(lr, -SAFE_LOG, SAFE_LOG))
    per = tokens.groupBy("traj_id").agg(
        F.sum("mask").alias("n"),
        masked_mean(logp).alias("lt"), masked_mean(rollout_logp).alias("lq"),
        F.sum(_m(-lr)).alias("kl"), F.sum(_m(F.exp(lr) - lr - 1)).alias("k3"),
        F.sum(_m(rho * rho)).alias("rr"), F.coalesce(F.sum(_m(lr)), F.lit(0.0)).alias("slr"),
    )
    n = F.sum("n") + EPS
    diff = F.col("lq") - F.col("lt")
    return per.agg(
        F.avg(F.exp(-F.col("lt"))).alias("training_ppl"), F.avg(-F.col("lt")).alias("training_log_ppl"),
        (F.sum("kl") / n).alias("kl"), (F.sum("k3") / n).alias("k3_kl"),
        F.avg(F.exp(-F.col("lq"))).alias("rollout_ppl"), F.avg(-F.col("lq")).alias("rollout_log_ppl"),
        F.avg(diff).alias("log_ppl_diff"), F.avg(F.abs(diff)).alias("log_ppl_abs_diff"),
        F.max(diff).alias("log_ppl_diff_max"), F.min(diff).alias("log_ppl_diff_min"),
        F.avg(F.exp(diff)).alias("ppl_ratio"),
        (F.sum("rr") / n - 1.0).alias("chi2_token"),
        (F.avg(F.exp(2.0 * clamp("slr", -SAFE_LOG, SAFE_LOG))) - 1.0).alias("chi2_seq"),
    )


def rollout_correction(
    tokens: DataFrame,
    level: str | None = None,
    threshold: float = 2.0,
    normalize: bool = False,
    rules: list[Rule] | None = None,
    logp: str = "old_logp",
    rollout_logp: str = "rollout_logp",
) -> tuple[DataFrame, DataFrame]:
    """Corrected tokens and their metrics.

    The mask is always replaced, ``is_weight`` is added only when a level is
    named; weights and metrics use the mask from before the rejection.
    """
    pol = {"logp": logp, "rollout_logp": rollout_logp}
    out = tokens
    metrics = to_long(offpolicy_metrics(tokens, **pol), "rollout_corr/")
    if level:
        out = is_weights(out, level, threshold, normalize, **pol)
        metrics = metrics.unionByName(to_long(is_metrics(tokens, level, threshold, **pol), "rollout_corr/"))
        if normalize:
            metrics = metrics.unionByName(to_long(is_norm_factor(tokens, level, threshold, **pol), "rollout_corr/"))
    if rules:
        out = rejection_mask(out, rules, **pol)
        rs = rejection_metrics(tokens, rules, **pol)
        metrics = metrics.unionByName(rs.withColumn("name", F.concat(F.lit("rollout_corr/"), "name")))
    return out, metrics


def logprob_drift(tokens: DataFrame) -> DataFrame:
    """How far the two engines' probabilities differ on valid tokens."""
    a, b = F.exp("old_logp"), F.exp("rollout_logp")
    d = F.abs(a - b)
    return tokens.where("mask = 1").agg(
        F.max(d).alias("diff_max"), F.avg(d).alias("diff_mean"), F.stddev_samp(d).alias("diff_std"),
        F.corr(a, b).alias("pearson"),
    )


def token_mismatch(tokens: DataFrame, left: str, right: str) -> DataFrame:
    """Valid positions per rollout where two columns differ."""
    return tokens.groupBy("traj_id").agg(
        F.count(F.when((F.col("mask") == 1) & (col(left) != col(right)), 1)).alias("mismatches")
    )


def variance_proxy(tokens: DataFrame, advantage: str = "advantage", is_weight: str | None = None, grad_norm: float | None = None) -> DataFrame:
    """Gradient variance proxies from the score-norm weight W = sum(1 - 2p + sum p^2)."""
    w = 1 - 2 * F.exp("old_logp") + F.col("sum_pi_sq")
    rho2 = F.col(is_weight) * F.col(is_weight) if is_weight else F.lit(1.0)
    base = w * rho2 / F.greatest(rho2, F.lit(1e-10)) if is_weight else w
    per = tokens.groupBy("traj_id").agg(
        masked_mean(advantage).alias("a"),
        F.coalesce(F.sum(_m(w * rho2)), F.lit(0.0)).alias("w"),
        F.greatest(F.coalesce(F.sum(_m(base)), F.lit(0.0)), F.lit(0.0)).alias("w0"),
        (masked_mean(is_weight) if is_weight else F.lit(1.0)).alias("rho"),
    )
    a2 = F.col("a") * F.col("a")
    p1 = F.lit(float(grad_norm) ** 2 if grad_norm is not None else 0.0)
    p2 = F.avg(F.col("rho") * F.col("rho") * a2 * F.col("w0"))
    rows = F.count(F.lit(1))
    p3 = F.lit(0.0) if grad_norm is None else F.when(rows > 1, F.greatest((p2 - p1) / (rows - 1), F.lit(0.0))).otherwise(0.0)
    return per.agg(
        F.max(p1).alias("proxy1_signal_strength"), p2.alias("proxy2_total_power"),
        p3.alias("proxy3_pure_noise"), F.avg(a2).alias("expected_a_squared"), F.avg("w").alias("expected_w"),
    )
