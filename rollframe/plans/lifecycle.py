"""The three whole jobs: build a prompt table, one training step's data work, and an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import advantages as A
from ..operators import filters as FI
from ..operators import format as M
from ..operators import offpolicy as O
from ..operators import sampling as S
from ..operators import validation as V
from ..session import cut


def build_prompt_table(rows: DataFrame, dataset: str, order: str, test_ratio: float, max_words: int, seed: int = 42) -> DataFrame:
    """Raw problem rows to train and test prompts: template, common columns, split, prompt schema, length filter."""
    d = M.prompt_template(rows)
    d = M.normalize_columns(d, dataset, order)
    d = S.split_by_ratio(d, "idx", test_ratio, seed)
    parts = [M.to_prompt_schema(d.where(F.col("split") == s), s) for s in ("train", "test")]
    return FI.filter_overlong_prompts(parts[0].unionByName(parts[1]), max_words)


def training_step(tokens: DataFrame, rules: list[O.Rule], beta: float = 0.001, threshold: float = 2.0) -> DataFrame:
    """Token rows ready for an update: KL in the reward, weights, rejection mask and group advantage.

    The rollout scores are written once between the two halves, so that the
    group statistics do not work the token plan out again.
    """
    t = A.kl_in_reward(tokens, "k3", beta)
    t, _ = O.rollout_correction(t, "token", threshold, rules=rules)
    return A.spread_to_tokens(t, A.adv_grpo(cut(A.outcome_scores(t))))


def evaluate(rollouts: DataFrame, variables=("score", "acc")) -> DataFrame:
    """The report of one validation run, from scored rollouts: mean, best, worst and majority at n of every variable.

    All of them follow from counted values and votes, which are written once.
    """
    names = list(variables)
    values, votes = V.value_counts(V.melt_vars(rollouts, names)), V.vote_counts(rollouts, names)
    return V.validation_report(V.counts_to_metrics(cut(values), cut(votes)))
