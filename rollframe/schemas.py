"""Declared schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)

PROMPTS = T.StructType([
    T.StructField("data_source", T.StringType()),
    T.StructField("prompt", MESSAGES),
    T.StructField("ability", T.StringType()),
    T.StructField("reward_model", T.StructType([
        T.StructField("style", T.StringType()),
        T.StructField("ground_truth", T.StringType()),
        T.StructField("reference", T.StringType()),
    ])),
    T.StructField("extra_info", T.StructType([
        T.StructField("split", T.StringType()),
        T.StructField("index", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("problem", T.StringType()),
        T.StructField("elo", T.StringType()),
        T.StructField("achievement_prior", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ])),
])

TESTS = T.StructType([
    T.StructField("inputs", T.ArrayType(T.StringType())),
    T.StructField("outputs", T.ArrayType(T.StringType())),
    T.StructField("testtype", T.StringType()),
    T.StructField("fn_name", T.StringType()),
    T.StructField("time_limit", T.DoubleType()),
])

GENERATIONS = T.StructType([
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
    T.StructField("gts", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("step", T.LongType()),
])

STEP_LINE = T.StructType([
    T.StructField("step", T.LongType()),
    T.StructField("data", T.MapType(T.StringType(), T.DoubleType())),
])

TOOL_CALL = T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])
