"""Step metrics and validation results that grow with a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.run_metrics import aggregate_step_metrics
from ..operators.validation import (
    counts_to_metrics, melt_vars, merge_partials, merge_value_counts, merge_vote_counts, partials_to_metrics, validation_partials, value_counts, vote_counts,
)
from .freshness import batch_folder, latest_updates, run_available  # noqa: F401


def streaming_step_metrics(
    metrics: DataFrame, version: str = "param_version", ts: str = "ts", span: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Running per-name accumulators, one row per (version, name, span of event time); update mode.

    A span is forgotten once the watermark has passed it, so the state holds the
    spans still open and not every version that ever was.  ``merge_spans`` adds
    the spans of a version up.
    """
    at = F.window(ts, span)
    return metrics.withWatermark(ts, delay).groupBy(version, "name", at.alias("_span")).agg(
        F.sum("value").alias("total"), F.count("value").alias("n"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max(F.struct("step", "value")).alias("last"),
    ).withColumn("span", F.col("_span.start")).drop("_span")


def merge_spans(last: DataFrame, version: str = "param_version") -> DataFrame:
    """The spans of each version and name to one row."""
    return last.groupBy(version, "name").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last")["value"].alias("last")
    )


def step_metrics_by_version(metrics: DataFrame, total_workers: int, version: str = "param_version") -> DataFrame:
    """Batch twin: the aggregated metrics of every version."""
    return aggregate_step_metrics(metrics, total_workers, [version])


def stream_validation(samples: DataFrame, path: str, checkpoint: str) -> None:
    """Every micro-batch adds its own partials; a repeated micro-batch replaces them."""
    write = batch_folder(path)
    run_available(samples, lambda batch, batch_id: write(validation_partials(batch), batch_id), checkpoint)


def merged_validation(spark: SparkSession, path: str) -> DataFrame:
    """Metrics over all partials so far."""
    return partials_to_metrics(merge_partials(spark.read.parquet(path).drop("batch_id")))


def stream_validation_counts(rollouts: DataFrame, variables: Sequence[str], path: str, checkpoint: str, order: str = "traj_id") -> None:
    """Every micro-batch adds its counted values and votes, from which all validation metrics follow."""
    values, votes = batch_folder(f"{path}/values"), batch_folder(f"{path}/votes")

    def write(batch: DataFrame, batch_id: int) -> None:
        values(value_counts(melt_vars(batch, variables)), batch_id)
        votes(vote_counts(batch, variables, order), batch_id)

    run_available(rollouts, write, checkpoint)


def merged_validation_counts(spark: SparkSession, path: str, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Mean, std, best, worst and majority at n over everything so far."""
    values, votes = (spark.read.parquet(f"{path}/{n}").drop("batch_id") for n in ("values", "votes"))
    return counts_to_metrics(merge_value_counts(values), merge_vote_counts(votes), n_boot, seed)
