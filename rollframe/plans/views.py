"""Given tables seen as rollouts, tokens, prompts and test records.

The same views are written twice: as DataFrames here and as CTE text in
``catalog/oracle.py`` for the check engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.groups import deal, number_rows


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _score(status: str = "o_orderstatus"):
    return (
        F.when(F.col(status) == "F", 1.0).when(F.col(status) == "P", 0.5).otherwise(0.0).cast("double")
    )


def line_count(spark: SparkSession, sf: str) -> int:
    """The number of lines; the token view has no more rows."""
    return table(spark, sf, "lineitem").count()


def tokens(spark: SparkSession, sf: str, rows: int | None = None) -> DataFrame:
    """One row per token: a line of an order is a token, an order is a trajectory.

    Lines are counted when this is called, unless ``rows`` says it: what a task sorts is bounded by the number of tasks.
    """
    rows = line_count(spark, sf) if rows is None else rows
    lines = table(spark, sf, "lineitem")
    lines = deal(lines.where(F.col("l_orderkey").isNotNull()), rows, "l_orderkey").join(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    in_order = W.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    base = lines.select(
        F.col("l_orderkey").alias("traj_id"),
        F.col("o_custkey").alias("uid"),
        F.row_number().over(in_order).cast("long").alias("t"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("mask"),
        (-(0.05 + 10 * F.col("l_discount"))).alias("old_logp"),
        (-(0.05 + 10 * F.col("l_tax"))).alias("rollout_logp"),
        (-(0.05 + F.col("l_quantity") / 50)).alias("ref_logp"),
        (F.col("l_quantity") / 100).alias("value"),
        _score().alias("_score"),
    )
    p = F.exp("old_logp")
    last = F.max(F.when(F.col("mask") == 1, F.col("t"))).over(W.partitionBy("traj_id"))
    return base.select(
        "traj_id", "uid", "t", "mask", "old_logp", "rollout_logp", "ref_logp", "value",
        (p * p + 0.5 * (1 - p) * (1 - p)).alias("sum_pi_sq"),
        F.when(F.col("t") == last, F.col("_score")).otherwise(F.lit(0.0)).alias("token_reward"),
    )


def rollouts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per rollout: an order, grouped by its customer."""
    lens = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", 0).otherwise(1)).alias("response_len")
    )
    orders = table(spark, sf, "orders")
    cust = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return (
        orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(lens, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_custkey").alias("uid"),
            F.col("o_orderkey").alias("traj_id"),
            F.col("c_mktsegment").alias("data_source"),
            F.col("o_orderpriority").alias("pred"),
            _score().alias("score"),
            F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).cast("double").alias("acc"),
            F.coalesce(F.col("response_len"), F.lit(0)).cast("long").alias("response_len"),
            (F.col("o_orderkey") % 7).alias("param_version"),
        )
    )


def numbered_rollouts(spark: SparkSession, sf: str) -> DataFrame:
    """Rollouts with their position inside the prompt group."""
    r = number_rows(rollouts(spark, sf), "traj_id", "sample_idx", ["uid"])
    return r.withColumn("sample_idx", F.col("sample_idx") - 1)


def test_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row per executed test: a line of an order is a test of that rollout's program."""
    in_order = W.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    passed = F.col("l_linestatus") == "F"
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("traj_id"),
        (F.row_number().over(in_order) - 1).cast("long").alias("test_idx"),
        F.concat(F.lit("n = "), F.col("l_partkey").cast("string"), F.lit("\nm = "), F.col("l_suppkey").cast("string")).alias("input"),
        F.col("l_suppkey").cast("string").alias("expected"),
        F.when(passed, F.col("l_suppkey").cast("string"))
        .when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 5 == 0), F.concat(F.lit("Error: "), F.col("l_partkey").cast("string")))
        .when((F.col("l_returnflag") == "A") & (F.col("l_partkey") % 7 == 0), F.lit("Time out"))
        .otherwise(F.concat(F.lit("out "), F.col("l_partkey").cast("string")))
        .alias("actual"),
        passed.alias("passed"),
        F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("dbg "), F.col("l_partkey").cast("string"))).otherwise(F.lit("")).alias("debug"),
    )
