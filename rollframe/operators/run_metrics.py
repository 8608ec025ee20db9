"""Metrics of a training step and of a run, as long ``(name, value)`` tables."""

from __future__ import annotations

from functools import reduce
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import when_chain
from ..functions.groups import cumulative_by_value
from .offpolicy import to_long

# fixed values: stages timed per token, and the rule lists of the step aggregator
RESPONSE_STAGES = ("gen",)
ALL_TOKEN_STAGES = ("ref", "values", "adv", "update_critic", "update_actor")
STEP_RULES = {
    "time_sum": ["perf/time_per_step"],
    "min": ["timing_s/agent_loop/tool_calls/min"],
    "avg": ["timing_s/agent_loop/tool_calls/mean"],
    "max": ["timing_s/agent_loop/tool_calls/max"],
    "last": [
        "fully_async/count/total_generated_samples",
        "fully_async/count/stale_samples_processed",
        "fully_async/count/stale_trajectory_processed",
        "fully_async/count/current_param_version",
        "fully_async/count/dropped_stale_samples",
        "training/global_step",
    ],
}
STEP_KEYWORDS = (
    ("time_sum", ("timing_s/",)),
    ("avg", ("mean", "avg", "average")),
    ("max", ("max", "maximum")),
    ("min", ("min", "minimum")),
    ("sum", ("sum", "total")),
)


def _three(prefix: str, x: Column, of=("mean", "max", "min")) -> dict[str, Column]:
    fn = {"mean": F.avg, "max": F.max, "min": F.min}
    return {f"{prefix}/{k}": fn[k](x) for k in of}


def data_metrics(
    tokens: DataFrame,
    rollouts: DataFrame,
    max_response_len: int,
    max_prompt_len: int,
    use_critic: bool = True,
) -> DataFrame:
    """Score, reward, advantage, return, value and length statistics of one step.

    ``tokens`` has ``token_score, token_reward, advantage, return, value, mask``;
    ``rollouts`` has ``traj_id, prompt_len, response_len`` and optionally
    ``num_turns, tool_calls``.  Rollouts of length 0 count as aborted: they stay
    out of score and reward, but not out of the length statistics.
    """
    on = lambda c: F.when(F.col("mask") == 1, F.col(c))
    tok = {**_three("critic/advantages", on("advantage")), **_three("critic/returns", on("return"))}
    if use_critic:
        tok |= _three("critic/values", on("value"))
        diff = F.when(F.col("mask") == 1, F.col("return") - F.col("value"))
        tok["critic/vf_explained_var"] = 1.0 - F.var_samp(diff) / (F.var_samp(on("return")) + 1e-5)
    token_part = to_long(tokens.agg(*[c.alias(k) for k, c in tok.items()]))

    sums = tokens.groupBy("traj_id").agg(F.sum("token_score").alias("_s"), F.sum("token_reward").alias("_r"))
    rows = rollouts.join(sums, "traj_id", "left")
    length = F.col("response_len")
    alive = length > 0
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    full = F.when(length == max_response_len, 1.0).otherwise(0.0)
    none_alive = F.raise_error(F.lit("all rollouts are aborted")).cast("double")
    part = {
        **_three("critic/score", F.when(alive, F.col("_s"))),
        **_three("critic/rewards", F.when(alive, F.col("_r"))),
        **_three("response_length", length),
        "response_length/clip_ratio": F.avg(full),
        **_three("response_length_non_aborted", F.when(alive, length)),
        "response_length_non_aborted/clip_ratio": F.when(F.count(F.when(alive, 1)) == 0, none_alive).otherwise(
            F.avg(F.when(alive, full))
        ),
        "response/aborted_ratio": share(~alive),
        **_three("prompt_length", F.col("prompt_len")),
        "prompt_length/clip_ratio": share(F.col("prompt_len") == max_prompt_len),
    }
    for c, name in (("num_turns", "num_turns"), ("tool_calls", "tool_call_counts")):
        if c in rollouts.columns:
            part |= _three(name, F.col(c), ("min", "max", "mean"))
    return token_part.unionByName(to_long(rows.agg(*[c.alias(k) for k, c in part.items()])))


def timing_metrics(stages: DataFrame, rollouts: DataFrame) -> DataFrame:
    """Seconds of every stage (``stage, seconds``) and milliseconds per token of the known ones."""
    n = rollouts.agg(
        F.struct(F.sum("response_len").alias("resp"), F.sum(F.col("prompt_len") + F.col("response_len")).alias("all"))
    ).scalar()
    s = stages.withColumn("_n", n)
    tokens = (
        F.when(F.col("stage").isin(*RESPONSE_STAGES), F.col("_n.resp"))
        .when(F.col("stage").isin(*ALL_TOKEN_STAGES), F.col("_n.all"))
    )
    both = F.array(
        F.struct(F.concat(F.lit("timing_s/"), "stage").alias("name"), F.col("seconds").alias("value")),
        F.struct(
            F.concat(F.lit("timing_per_token_ms/"), "stage").alias("name"),
            (F.col("seconds") * 1000 / tokens).alias("value"),
        ),
    )
    return s.select(F.inline(F.filter(both, lambda x: x["value"].isNotNull())))


def throughput_metrics(stages: DataFrame, rollouts: DataFrame, n_workers: int) -> DataFrame:
    """Tokens of the step, its seconds, and tokens per second and worker."""
    step = stages.where("stage = 'step'").agg(F.max("seconds")).scalar()
    total = rollouts.agg(F.sum(F.col("prompt_len") + F.col("response_len")).cast("double").alias("n"))
    row = total.select(
        F.col("n").alias("perf/total_num_tokens"), step.alias("perf/time_per_step"),
        (F.col("n") / (step * n_workers)).alias("perf/throughput"),
    )
    return to_long(row)


def reduce_metrics(values: DataFrame, explicit: dict[str, str] | None = None) -> DataFrame:
    """Many values of a name to one: an explicit rule, else by whether the name contains max or min, else the mean."""
    rules = [(F.col("name") == k, v) for k, v in (explicit or {}).items()]
    fn = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum}
    for _, v in rules:
        if v not in fn:
            raise ValueError(f"unknown aggregation {v!r}")
    how = when_chain(
        [(c, F.lit(v)) for c, v in rules]
        + [(F.col("name").contains("max"), F.lit("max")), (F.col("name").contains("min"), F.lit("min"))],
        F.lit("mean"),
    )
    value = F.col("value")
    return values.groupBy("name").agg(
        F.max("value").alias("max"), F.min("value").alias("min"), F.avg(value).alias("mean"), F.sum(value).alias("sum")
    ).withColumn("_how", how).select("name", when_chain([(F.col("_how") == k, F.col(k)) for k in fn]).alias("value"))


def merge_accumulators(parts: DataFrame) -> DataFrame:
    """Metric partials ``(name, kind, total, n, low, high)`` of many workers to one value per name."""
    by = when_chain(
        [
            (F.col("kind") == "mean", F.sum("total") / F.sum("n")),
            (F.col("kind") == "sum", F.sum("total")),
            (F.col("kind") == "min", F.min("low")),
            (F.col("kind") == "max", F.max("high")),
        ]
    )
    return parts.groupBy("name", "kind").agg(by.alias("value"))


def sanitize_metric_names(df: DataFrame, name: str = "name", out: str = "clean") -> DataFrame:
    """``@`` to ``_at_``, runs of ``/`` to one, other characters outside the allowed set to ``_``."""
    c = F.regexp_replace(F.col(name), "@", "_at_")
    c = F.regexp_replace(c, "/+", "/")
    return df.withColumn(out, F.regexp_replace(c, r"(?U)[^/\w.\- :]", "_"))


def name_collisions(df: DataFrame, name: str = "name") -> DataFrame:
    """Clean names that more than one original name maps to."""
    clean = sanitize_metric_names(df.select(name).distinct(), name)
    return clean.groupBy("clean").agg(F.count(F.lit(1)).alias("names")).where("names > 1")


def compare_runs(golden: DataFrame, others: DataFrame, tolerance: dict[str, tuple[float, float]]) -> DataFrame:
    """Metrics ``(step, name, value)`` of other runs (plus ``run``) against a golden run, within atol + rtol |other|."""
    atol = when_chain([(F.col("name") == k, F.lit(float(a))) for k, (a, _) in tolerance.items()])
    rtol = when_chain([(F.col("name") == k, F.lit(float(r))) for k, (_, r) in tolerance.items()])
    g = golden.where(F.col("name").isin(*tolerance)).select("step", "name", F.col("value").alias("golden"))
    o = others.where(F.col("name").isin(*tolerance))
    gap = F.abs(F.col("golden") - F.col("value"))
    return o.join(g, ["step", "name"]).withColumn("close", gap <= atol + rtol * F.abs("value"))


def _step_rule() -> Column:
    low = F.lower("name")
    pairs = [(F.col("name").isin(*names), F.lit(rule)) for rule, names in STEP_RULES.items()]
    for rule, words in STEP_KEYWORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        pairs.append((hit, F.lit(rule)))
    return when_chain(pairs, F.lit("avg"))


def aggregate_step_metrics(metrics: DataFrame, total_workers: int, keys: Sequence[str] = ()) -> DataFrame:
    """Many steps ``(step, name, value)`` to one value per name, by rule list and then name keywords.

    The derived names (length spread, throughput, idle ratio) are worked out
    from the aggregated ones.  ``keys`` keeps groups such as parameter versions
    apart.
    """
    keys = list(keys)
    a = metrics.groupBy(*keys, "name").agg(
        F.sum("value").alias("_sum"), F.avg("value").alias("_avg"), F.max("value").alias("_max"),
        F.min("value").alias("_min"), F.max_by("value", "step").alias("_last"),
    )
    rule = _step_rule()
    value = when_chain(
        [
            (rule.isin("sum", "time_sum"), F.col("_sum")), (rule == "max", F.col("_max")),
            (rule == "min", F.col("_min")), (rule == "last", F.col("_last")),
        ],
        F.col("_avg"),
    )
    a = a.select(*keys, "name", value.alias("value"))
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    wide = a.groupBy(*keys).agg(
        pick("global_seqlen/max").alias("gmax"), pick("global_seqlen/min").alias("gmin"),
        pick("global_seqlen/minmax_diff").alias("gdiff"), pick("perf/throughput").alias("thr"),
        pick("perf/total_num_tokens").alias("tok"), pick("perf/time_per_step").alias("sec"),
        pick("timing_s/gen").alias("gen"), pick("timing_s/step").alias("stp"),
    )
    derived = F.array(
        F.struct(
            F.lit("global_seqlen/minmax_diff").alias("name"),
            F.when(F.col("gdiff").isNotNull(), F.col("gmax") - F.col("gmin")).alias("value"),
        ),
        F.struct(
            F.lit("perf/throughput").alias("name"),
            F.when(F.col("thr").isNotNull(), F.col("tok") / (F.col("sec") * total_workers)).alias("value"),
        ),
        F.struct(F.lit("trainer/idle_ratio").alias("name"), (F.col("gen") / F.col("stp")).alias("value")),
    )
    derived = wide.select(*keys, F.inline(derived)).where("value is not null")
    plain = a.join(derived.select(*keys, "name"), [*keys, "name"], "left_anti")
    return plain.unionByName(derived)


def exact_percentiles(df: DataFrame, value: str, points: Sequence[float]) -> DataFrame:
    """Linear-interpolated percentiles from running counts over distinct values, one column per point.

    Only the order statistics next to each point are read off, so no task holds
    all values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_k"))
    upto = cumulative_by_value(counts, [], value, "_k", "_upto")
    n = df.agg(F.count(value)).scalar()
    upto = upto.withColumn("_total", n)
    out = []
    for p in points:
        h = (F.col("_total") - 1) * p
        at = lambda k: F.min(F.when(F.col("_upto") >= k + 1, F.col(value)))
        lo, hi = at(F.floor(h)), at(F.ceil(h))
        frac = F.max(h - F.floor(h))
        out.append((lo + (hi - lo) * frac).alias(f"p{p:g}"))
    return upto.agg(*out)


def latency_percentiles(samples: DataFrame, seconds: str = "processing_time", tool: str = "tool_time") -> DataFrame:
    """Processing-time average, extremes and percentiles, and tool-time extremes; long table."""
    base = samples.agg(
        F.avg(seconds).alias("fully_async/processing_time/avg"), F.max(seconds).alias("fully_async/processing_time/max"),
        F.min(seconds).alias("fully_async/processing_time/min"),
        F.max(tool).alias("timing_s/agent_loop/tool_calls/max"), F.min(tool).alias("timing_s/agent_loop/tool_calls/min"),
        F.avg(tool).alias("timing_s/agent_loop/tool_calls/mean"),
    )
    p = exact_percentiles(samples, seconds, (0.5, 0.99, 0.95))
    p = p.select(*[F.col(f"`p{q}`").alias(f"fully_async/processing_time/tp{t}") for q, t in (("0.5", 50), ("0.99", 99), ("0.95", 95))])
    return to_long(base).unionByName(to_long(p)).where("value is not null")


def sketch_rank_error(size: int) -> float:
    """How far the rank of a sketched percentile may lie from what was asked, as a share of the samples (99 of 100 cases)."""
    return 2.296 / size**0.9021


def latency_sketches(samples: DataFrame, keys: Sequence[str] = (), seconds: str = "processing_time", size: int = 2048) -> DataFrame:
    """Mergeable summary of the times of every group: ``*keys, n, total, low, high, sketch``.

    The sketch holds a few thousand numbers whatever the number of samples; it is
    built where the samples are, so a hot group is no more than one row a task.
    ``sketch_rank_error`` tells how exact ``size`` is; ``latency_percentiles`` is
    the exact way.
    """
    x = F.col(seconds).cast("double")
    return samples.where(x.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"), F.kll_sketch_agg_double(x, size).alias("sketch")
    )


def merge_latency_sketches(*parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Summaries of several runs, batches or streams to one per group, in any order."""
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def sketch_percentiles(sketches: DataFrame, keys: Sequence[str] = (), points: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Mean, extremes and approximate percentiles of every group: ``*keys, n, avg, min, max, tp50, ...``."""
    at = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"tp{100 * p:g}") for p in points]
    return sketches.select(*keys, "n", (F.col("total") / F.col("n")).alias("avg"), F.col("low").alias("min"), F.col("high").alias("max"), *at)


def slowest_sample(samples: DataFrame) -> DataFrame:
    """Generation and tool seconds (min, max, mean) and the sample with the largest sum, the first on ties."""
    total = F.col("gen_time") + F.col("tool_time")
    s = F.max_by(
        F.struct("gen_time", "tool_time", "prompt_len", "response_len"), F.struct(total, -F.col("traj_id"))
    )
    a = samples.agg(
        *[c.alias(k) for k, c in {
            **_three("agent_loop/generate_sequences", F.col("gen_time"), ("min", "max", "mean")),
            **_three("agent_loop/tool_calls", F.col("tool_time"), ("min", "max", "mean")),
        }.items()],
        s.alias("_s"),
    )
    named = [
        F.col("_s.gen_time").alias("agent_loop/slowest/generate_sequences"),
        F.col("_s.tool_time").alias("agent_loop/slowest/tool_calls"),
        F.col("_s.prompt_len").alias("agent_loop/slowest/prompt_length"),
        F.col("_s.response_len").alias("agent_loop/slowest/response_length"),
    ]
    return to_long(a.select("*", *named).drop("_s"))


def retry_summary(turns: DataFrame) -> DataFrame:
    """Per question of a multi-turn run (``question_id, turn, reward, context_len``)."""
    return turns.groupBy("question_id").agg(
        (F.max("turn") + 1).alias("total_turns"),
        F.max_by("reward", "turn").alias("final_reward"),
        F.min(F.when(F.col("reward") >= 1.0, F.col("turn"))).alias("first_solved_turn"),
        F.max("context_len").alias("max_context_len"),
    )


def feedback_generation_metrics(responses: DataFrame, seconds: float, step_seconds: float | None = None) -> DataFrame:
    """Counts, tokens and rates of one feedback generation (``text, attempts, success, tokens``); long table.

    When no token counts were reported, the words of the texts count instead.
    """
    text = F.trim("text")
    words = F.when(F.length(text) > 0, F.size(F.split(text, r"\s+"))).otherwise(0)
    a = responses.agg(
        F.sum(F.greatest("tokens", F.lit(0))).cast("double").alias("t"), F.sum(words).cast("double").alias("w"),
        F.count(F.lit(1)).cast("double").alias("requests_requested"),
        F.sum(F.greatest("attempts", F.lit(1))).cast("double").alias("api_requests_sent"),
        F.count(F.when(F.length(text) > 0, 1)).cast("double").alias("generated_feedback_count"),
        F.count(F.when(~F.col("success"), 1)).cast("double").alias("failed_feedback_count"),
    )
    tok = F.when(F.col("t") == 0, F.col("w")).otherwise(F.col("t"))
    out = [
        tok.alias("generated_tokens"),
        (tok / max(seconds, 1e-8)).alias("tokens_per_second"),
        F.lit(float(seconds)).alias("total_duration_s"),
        "requests_requested", "api_requests_sent", "generated_feedback_count", "failed_feedback_count",
        F.greatest(F.col("api_requests_sent") - F.col("requests_requested"), F.lit(0.0)).alias("retry_count"),
    ]
    if step_seconds and step_seconds > 0:
        out += [
            F.lit(seconds / step_seconds).alias("time_fraction_of_step"),
            F.lit(100.0 * seconds / step_seconds).alias("time_percent_of_step"),
        ]
    return to_long(a.select(*out), "self_distillation/feedback_generator/")
