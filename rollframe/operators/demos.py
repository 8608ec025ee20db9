"""Successful answers and feedback joined back to the rollouts of the same prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.groups import attach_by_key, number_rows, previous_value, running_total

# fixed values: the wording of re-prompts
REPROMPT = "{prompt}{solution}{feedback}\n\nCorrectly solve the original question."
SOLUTION = "\nCorrect solution:\n\n{successful_previous_attempt}"
FEEDBACK = "\nThe following is feedback from your unsuccessful earlier attempt:\n\n{feedback_raw}"
FEEDBACK_FROM_REFERENCE = "\n{feedback_raw}\n"
REFERENCE_FEEDBACK = "\n\nHere is a correct answer to this problem:\n{reference}\n\n"


def fill(template: str, **slots: Column) -> Column:
    """A text template with ``{name}`` slots as one concat."""
    import re

    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(slots[piece])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def strip_thinking(text: str | Column) -> Column:
    """Text without thinking spans and the blanks behind them."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?s)<think>.*?</think>\s*", "")


def successful_by_group(rollouts: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Rollouts that reach ``threshold``, numbered within their prompt in row order (long, not one array per prompt)."""
    good = rollouts.where(F.col("score") >= threshold).select("uid", "traj_id")
    return number_rows(good, "traj_id", "success_no", ["uid"])


def pick_demonstration(
    rollouts: DataFrame,
    threshold: float = 1.0,
    exclude_self: bool = False,
    remove_thinking: bool = False,
    response: str | None = None,
) -> DataFrame:
    """Adds ``demo_traj_id`` (and its text as ``solution``): the first success of the prompt, null if none.

    Two successes per prompt answer every row, and Spark cuts the ranking
    window to two rows per prompt before the shuffle.
    """
    cols = ["traj_id"] + ([response] if response else [])
    rank = F.row_number().over(W.partitionBy("uid").orderBy("traj_id"))
    two = rollouts.where(F.col("score") >= threshold).select("uid", *cols).withColumn("_rk", rank).where("_rk <= 2")
    item = F.struct(*cols)
    pair = two.groupBy("uid").agg(
        F.max(F.when(F.col("_rk") == 1, item)).alias("_a"), F.max(F.when(F.col("_rk") == 2, item)).alias("_b")
    )
    out = attach_by_key(rollouts, ["uid"], pair)
    pick = F.col("_a")
    if exclude_self:
        pick = F.when(F.col("_a.traj_id") == F.col("traj_id"), F.col("_b")).otherwise(F.col("_a"))
    out = out.withColumn("_d", pick).withColumn("demo_traj_id", F.col("_d.traj_id"))
    if response:
        text = F.col(f"_d.{response}")
        out = out.withColumn("solution", strip_thinking(text) if remove_thinking else text)
    return out.drop("_a", "_b", "_d")


def nonblank(text: str) -> Column:
    return F.when(F.length(F.regexp_replace(F.col(text), r"\s", "")) > 0, F.col(text))


def collect_feedback(
    rollouts: DataFrame,
    environment: str = "feedback",
    generated: str | None = None,
    include_environment: bool = True,
    only_where: Column | None = None,
) -> DataFrame:
    """Adds ``feedback_text``: generated text where wanted, else non-blank environment feedback, else null.

    A generator serves the whole batch, so environment feedback counts only when
    no generated column is given.
    """
    if generated:
        text = F.trim(F.col(generated))
        out = F.when(F.length(text) > 0, text)
        if only_where is not None:
            out = F.when(only_where, out)
    else:
        out = nonblank(environment) if include_environment else F.lit(None).cast("string")
    return rollouts.withColumn("feedback_text", out)


def reference_feedback(
    rollouts: DataFrame, reference: str = "reference", ground_truth: str = "ground_truth", required: bool = False
) -> DataFrame:
    """Adds ``generated_feedback`` that shows the reference solution, or the ground truth where there is none."""
    ref = F.trim(F.coalesce(F.col(reference), F.col(ground_truth), F.lit("")))
    none = F.raise_error(F.lit("reference feedback needs a reference or ground truth")).cast("string") if required else F.lit("")
    return rollouts.withColumn(
        "generated_feedback", F.when(F.length(ref) > 0, fill(REFERENCE_FEEDBACK, reference=ref)).otherwise(none)
    )


def _used(feedback_only_without_solution: bool) -> Column:
    has = F.col("feedback_text").isNotNull()
    return has & F.col("solution").isNull() if feedback_only_without_solution else has


def reprompt_table(
    rollouts: DataFrame,
    feedback_only_without_solution: bool = False,
    template: str = REPROMPT,
    solution_template: str = SOLUTION,
    feedback_template: str = FEEDBACK,
    system: str | None = None,
) -> DataFrame:
    """Adds ``reprompt`` (messages) and ``reprompted``, from ``prompt, solution, feedback_text``.

    A row with neither solution nor used feedback keeps its prompt.
    """
    used = _used(feedback_only_without_solution)
    sol = F.when(F.col("solution").isNotNull(), fill(solution_template, successful_previous_attempt=F.col("solution"))).otherwise("")
    fb = F.when(used, fill(feedback_template, feedback_raw=F.col("feedback_text"))).otherwise("")
    changed = used | F.col("solution").isNotNull()
    text = F.when(changed, fill(template, prompt=F.col("prompt"), solution=sol, feedback=fb)).otherwise(F.col("prompt"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    user = F.array(message("user", text))
    messages = F.concat(F.array(message("system", F.col(system))), user) if system else user
    return rollouts.withColumn("reprompt", messages).withColumn("reprompted", changed)


def reprompt_metrics(
    rollouts: DataFrame,
    threshold: float = 1.0,
    feedback_only_without_solution: bool = False,
    use_solution: bool = True,
) -> DataFrame:
    """Shares of groups with a success and of rows with solution, feedback and re-prompt; one row.

    ``available`` is the demonstration a row could use, ``solution`` what it does use.
    """
    used = _used(feedback_only_without_solution)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    per = rollouts.groupBy("uid").agg(F.max("score").alias("_s"))
    groups = per.agg(F.avg(F.when(F.col("_s") >= threshold, 1.0).otherwise(0.0))).scalar()
    has = F.col("solution").isNotNull() & F.lit(use_solution)
    return rollouts.agg(
        share(F.col("available").isNotNull()).alias("success_sample_fraction"),
        share(has).alias("solution_used_fraction"),
        share(F.col("feedback_text").isNotNull()).alias("feedback_available_fraction"),
        share(used).alias("feedback_used_fraction"),
        share(has | used).alias("reprompt_sample_fraction"),
    ).withColumn("success_group_fraction", groups)


def shared_prefix_groups(rows: DataFrame, order: str = "traj_id", label: str = "uid") -> DataFrame:
    """Runs of equal neighbouring labels in row order: number, label, first row and size."""
    d = previous_value(rows.select(order, label), order, label, "_prev")
    start = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col(label)), 1).otherwise(0)
    d = running_total(d.withColumn("_start", start), [], order, {"group_no": F.col("_start").cast("long")})
    return d.groupBy("group_no", label).agg(F.min(order).alias("first_row"), F.count(F.lit(1)).alias("group_size"))
