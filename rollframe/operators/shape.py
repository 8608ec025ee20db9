"""Token tables and token arrays: masks, positions, padding, packing and rewards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import col
from ..functions.groups import attach_by_key, number_by_hash, number_rows, running_total


# ---------------------------------------------------------------- long token table
def response_mask(tokens: DataFrame, eos_ids: Sequence[int], token: str = "token", out: str = "mask") -> DataFrame:
    """1 up to and including the first end token of a response."""
    eos = F.when(F.col(token).isin(*eos_ids), 1).otherwise(0)
    seen = F.sum(eos).over(W.partitionBy("traj_id").orderBy("t").rowsBetween(W.unboundedPreceding, 0)) - eos
    return tokens.withColumn(out, F.when(seen == 0, 1).otherwise(0))


def position_ids(tokens: DataFrame, mask: str = "mask", out: str = "position_id") -> DataFrame:
    """Running count of the mask minus one, at least 0."""
    run = F.sum(mask).over(W.partitionBy("traj_id").orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    return tokens.withColumn(out, F.greatest(run - 1, F.lit(0)))


def pack_valid_tokens(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid tokens in one flat order (``flat_idx``), and per rollout its ``row_start`` and ``row_len``."""
    lens = tokens.groupBy("traj_id").agg(F.sum("mask").cast("long").alias("row_len"))
    starts = running_total(lens, [], "traj_id", {"_end": F.col("row_len")})
    starts = starts.select("traj_id", (F.col("_end") - F.col("row_len")).alias("row_start"), "row_len")
    nth = F.row_number().over(W.partitionBy("traj_id").orderBy("t")) - 1
    flat = tokens.where("mask = 1").withColumn("_nth", nth).join(starts.select("traj_id", "row_start"), "traj_id")
    return flat.withColumn("flat_idx", F.col("row_start") + F.col("_nth")).drop("_nth", "row_start"), starts


def unpack_tokens(tokens: DataFrame, flat: DataFrame, value: str, fill: float = 0.0) -> DataFrame:
    """Put a value of the flat tokens back in place; padding gets ``fill``."""
    d = tokens.join(flat.select("traj_id", "t", F.col(value).alias("_v")), ["traj_id", "t"], "left")
    return d.withColumn(value, F.coalesce("_v", F.lit(fill))).drop("_v")


def token_reward_at_end(tokens: DataFrame, rollouts: DataFrame, score: str = "score") -> DataFrame:
    """The rollout's score on its last valid token, 0 elsewhere.  An empty rollout has no token to carry it."""
    last = F.max(F.when(F.col("mask") == 1, F.col("t"))).over(W.partitionBy("traj_id"))
    d = tokens.drop("token_reward").withColumn("_last", last)
    d = d.join(rollouts.select("traj_id", F.col(score).alias("_s")), "traj_id")
    return d.withColumn("token_reward", F.when(F.col("t") == F.col("_last"), F.col("_s")).otherwise(0.0)).drop("_last", "_s")


def overlong_penalty(rollouts: DataFrame, max_len: int, buffer: int, factor: float = 1.0) -> DataFrame:
    """Adds ``overlong_reward`` (never positive), ``overlong`` and the penalised ``score``."""
    over = F.col("response_len") - (max_len - buffer)
    pen = F.least(-over / buffer * factor, F.lit(0.0))
    return rollouts.withColumn("overlong_reward", pen).withColumn("overlong", F.col("overlong_reward") < 0).withColumn(
        "score", F.col("score") + F.col("overlong_reward")
    )


def assemble_rollout_rows(*parts: DataFrame, score: str = "score") -> DataFrame:
    """Stack finished samples; a column some lack is null there; ``use_score`` says whether every sample has one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    complete = out.agg(F.bool_and(F.col(score).isNotNull())).scalar()
    return out.withColumn("use_score", complete)


def group_index(df: DataFrame, label: str, out: str = "group_no") -> DataFrame:
    """Dense group numbers 0..G-1 of any labels; near-integer floats are rounded first."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    key = F.col(label)
    if kinds[label] in ("double", "float"):
        key = F.when(F.abs(key - F.round(key)) < 1e-6, F.round(key)).otherwise(key)
    d = df.withColumn("_label", key)
    names = d.select("_label").distinct()
    if kinds[label] in ("bigint", "int", "smallint", "tinyint"):
        numbered = number_rows(names, "_label", out)
    else:
        numbered = number_by_hash(names, ["_label"], 0, out)
    return attach_by_key(d, ["_label"], numbered.withColumn(out, F.col(out) - 1)).drop("_label")


def rollout_number(rollouts: DataFrame, key: str = "uid", order: str = "traj_id", out: str = "rollout_no") -> DataFrame:
    """0-based running number of a rollout within its prompt."""
    return number_rows(rollouts, order, out, [key]).withColumn(out, F.col(out) - 1)


def segments_to_response_mask(
    segments: DataFrame, max_len: int, key: str = "conv_id", order: str = "turn", ids: str = "ids", model: str = "is_model"
) -> DataFrame:
    """Ordered segments to token rows ``key, t, token, mask``: 1 on model tokens, 0 on tool and user tokens; cut at ``max_len``.

    Each segment learns its offset from a running sum, so no conversation is
    collected.
    """
    d = running_total(segments.withColumn("_len", F.size(ids).cast("long")), [key], order, {"_end": F.col("_len")})
    d = d.withColumn("_from", F.col("_end") - F.col("_len")).where(F.col("_from") < max_len)
    d = d.select(key, "_from", F.when(F.col(model), 1).otherwise(0).alias("mask"), F.posexplode(ids).alias("_i", "token"))
    return d.withColumn("t", F.col("_from") + F.col("_i") + 1).where(F.col("t") <= max_len).select(key, "t", "token", "mask")


# ---------------------------------------------------------------- arrays
def zeros(n: Column, value: int = 0) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(n, F.lit(0)).cast("int"))


def response_slice_mask(mask: str | Column, length: int) -> Column:
    """The last ``length`` entries of an attention mask."""
    m = col(mask)
    return F.slice(m, F.greatest(F.size(m) - length, F.lit(0)) + 1, F.lit(length))


def truncate(arr: str | Column, max_len: int, truncation: str = "error") -> Column:
    """Cut an array to ``max_len``: drop the left, the right or the middle, or fail."""
    a = col(arr)
    n = F.size(a)
    half = max_len // 2
    if truncation == "left":
        cut = F.slice(a, n - max_len + 1, F.lit(max_len))
    elif truncation == "right":
        cut = F.slice(a, 1, max_len)
    elif truncation == "middle":
        cut = F.concat(F.slice(a, 1, half), F.slice(a, n - (max_len - half) + 1, F.lit(max_len - half)))
    elif truncation == "error":
        cut = F.when(n > max_len, F.raise_error(F.lit(f"sequence is longer than {max_len}")).cast("array<int>"))
    else:
        raise ValueError(f"unknown truncation {truncation!r}")
    return F.when(n > max_len, cut).otherwise(a)


def pad_truncate(arr: str | Column, max_len: int, pad: int = 0, left_pad: bool = True, truncation: str = "error") -> Column:
    """Array of exactly ``max_len``: padded on one side, or cut."""
    a = truncate(arr, max_len, truncation)
    fill = zeros(F.lit(max_len) - F.size(a), pad)
    return F.concat(fill, a) if left_pad else F.concat(a, fill)


def strip_padding(ids: str, mask: str) -> Column:
    """Valid ids of a padded row."""
    pairs = F.filter(F.arrays_zip(F.col(ids).alias("i"), F.col(mask).alias("m")), lambda p: p["m"] == 1)
    return F.transform(pairs, lambda p: p["i"])


def sft_loss_mask(
    df: DataFrame, prompt: str = "prompt_ids", response: str = "response_ids", max_len: int = 512, pad: int = 0, truncation: str = "error"
) -> DataFrame:
    """Adds ``input_ids, attention_mask, position_ids, loss_mask`` of fixed length.

    Loss falls on response tokens only: the first ``prompt - 1`` entries and the
    entry of the last response token are 0.
    """
    p, r = F.size(prompt), F.size(response)
    both = F.concat(F.col(prompt), F.col(response))
    d = df.withColumn("input_ids", pad_truncate(both, max_len, pad, False, truncation))
    ones = truncate(F.transform(both, lambda _: F.lit(1)), max_len, truncation)
    d = d.withColumn("attention_mask", F.concat(ones, zeros(F.lit(max_len) - F.size(ones))))
    valid = F.size(ones)
    d = d.withColumn("position_ids", F.transform("attention_mask", lambda _, i: F.greatest(F.least(i, valid - 1), F.lit(0))))
    head = F.when(p > 1, F.least(p, F.lit(max_len)) - 1).otherwise(0)
    last = F.least(p + r, F.lit(max_len)) - 1
    return d.withColumn(
        "loss_mask", F.transform("attention_mask", lambda m, i: F.when((i < head) | (i == last), 0).otherwise(m))
    )


def multiturn_loss_mask(
    turns: DataFrame, max_len: int, pad: int = 0, truncation: str = "error",
    key: str = "conv_id", order: str = "turn", ids: str = "ids", role: str = "role", prefix_len: int = 0,
    padded: bool = True,
) -> DataFrame:
    """One row per conversation: ``input_ids, attention_mask, loss_mask, position_ids``, of fixed length if ``padded``.

    Loss falls on assistant tokens behind the ``prefix_len`` tokens of the
    generation prefix.
    """
    n = F.size(ids)
    assistant = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i > prefix_len, 1).otherwise(0))
    mask = F.when(n == 0, F.array().cast("array<int>")).when(F.col(role) == "assistant", assistant).otherwise(zeros(n))
    g = turns.withColumn("_m", mask).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(order, F.col(ids).alias("i"), F.col("_m").alias("m")))).alias("_t")
    )
    g = g.withColumn("_i", F.flatten("_t.i")).withColumn("_l", F.flatten("_t.m"))
    total = F.size("_i")
    kept = F.least(total, F.lit(max_len))
    # a cut on the left keeps the positions of the whole conversation
    skipped = F.greatest(total - max_len, F.lit(0)) if truncation == "left" else F.lit(0)
    ids_, loss = truncate("_i", max_len, truncation), truncate("_l", max_len, truncation)
    places = F.when(kept == 0, F.array().cast("array<int>")).otherwise(F.sequence(skipped, skipped + kept - 1))
    ones = F.transform(ids_, lambda _: F.lit(1))
    fill = F.lit(max_len) - kept if padded else F.lit(0)
    return g.select(
        key,
        F.concat(ids_, zeros(fill, pad)).alias("input_ids"),
        F.concat(ones, zeros(fill)).alias("attention_mask"),
        F.concat(loss, zeros(fill)).alias("loss_mask"),
        F.concat(places, zeros(fill)).alias("position_ids"),
    )


def preference_pair_arrays(
    df: DataFrame, max_len: int, eos: int | None = None, prompt="prompt_ids", chosen="chosen_ids", rejected="rejected_ids"
) -> DataFrame:
    """Adds ``input_ids`` and ``attention_mask`` with the chosen and the rejected sequence, right padded with 0 or cut."""
    end = F.array(F.lit(eos)) if eos is not None else F.array().cast("array<int>")

    def row(answer: str) -> tuple[Column, Column]:
        seq = F.concat(F.col(prompt), F.col(answer), end)
        return pad_truncate(seq, max_len, 0, False, "right"), pad_truncate(F.transform(seq, lambda _: F.lit(1)), max_len, 0, False, "right")

    (ci, cm), (ri, rm) = row(chosen), row(rejected)
    return df.withColumn("input_ids", F.array(ci, ri)).withColumn("attention_mask", F.array(cm, rm))
