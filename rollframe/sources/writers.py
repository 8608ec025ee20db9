"""Training, generation and metric writers.  Files are written by the tasks, never by the driver."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import folder_name, local_path

PARQUET_BLOCK = 8 << 20


def write_training_parquet(df: DataFrame, path: str, block_bytes: int = PARQUET_BLOCK, mode: str = "errorifexists") -> None:
    """zstd parquet with small row groups, so that a loader can read a few rows at a time."""
    df.write.mode(mode).option("compression", "zstd").option("parquet.block.size", block_bytes).parquet(path)


def write_json_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def dump_generations(df: DataFrame, path: str) -> None:
    """Append a step's samples ``input, output, gts, score, step`` and any further columns, one folder per step."""
    need = {"input", "output", "gts", "score", "step"}
    if not need <= set(df.columns):
        raise ValueError(f"missing columns {sorted(need - set(df.columns))}")
    df.withColumn("step_dir", F.col("step")).write.mode("append").partitionBy("step_dir").json(path)


def step_metrics_sink(metrics: DataFrame) -> DataFrame:
    """One JSON line per step, ``{"step": ..., "data": {name: value}}``; names in order."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "value")))
    g = metrics.groupBy("step").agg(F.map_from_entries(pairs).alias("data"))
    return g.select(F.to_json(F.struct("step", "data")).alias("line"))


def write_step_metrics(metrics: DataFrame, path: str) -> None:
    step_metrics_sink(metrics).write.mode("append").text(path)


def _singleton_files(root: str, question: str, job: str):
    """Lines, in order of their questions, to the files of each question; one row with the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        name, attempt = f"part-{at.partitionId():05d}-{job}.c000.json", at.taskAttemptId()
        files, folder, parts = 0, None, {}

        def close() -> None:
            for split, part in parts.items():
                part.close()
                os.replace(part.name, f"{folder}/split={split}/{name}")

        for batch in batches:
            for own, copy, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = f"{root}/{folder_name(question, own)}"
                if own != folder:
                    close()
                    folder, parts = own, {}
                    for split in ("train", "test"):
                        os.makedirs(f"{folder}/split={split}", exist_ok=True)
                        parts[split] = open(f"{folder}/split={split}/.{name}.{attempt}", "w", encoding="utf-8", newline="")  # noqa: SIM115
                    files += 2
                parts["train"].write(f"{line}\n")
                if copy == 0:
                    parts["test"].write(f"{line}\n")
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return run


def write_singletons(df: DataFrame, path: str, question: str = "question_id", copies: int = 4) -> None:
    """One dataset per question: its rows ``copies`` times under ``train`` and once under ``test``.

    The work is in the files and not in their bytes, so questions are dealt over
    a given number of tasks: one that follows the bytes would leave all to two.

    In a local or mounted folder each task opens its files itself, by the names
    that Spark gives them.  Spark's writer starts a process there for each folder, file and
    checksum, to set its permissions, and its driver moves the files one by
    one.  A file appears whole, and ``_SUCCESS`` after the last of them.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    root = local_path(spark, path)
    if root is None:
        df = df.repartition(tasks, question)
        train = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("split", F.lit("train"))
        test = df.withColumn("copy", F.lit(0)).withColumn("split", F.lit("test"))
        train.unionByName(test).write.mode("errorifexists").partitionBy(question, "split").json(path)
        return
    if os.path.lexists(root):
        raise AnalysisException(f"[PATH_ALREADY_EXISTS] Path {path} already exists.")
    os.makedirs(root)
    rest = [c for c in df.columns if c not in (question, "copy", "split")]
    named = df.select(F.col(question).cast("string").alias("_question"), *rest).repartition(tasks, "_question").sortWithinPartitions("_question")
    rows = named.select("_question", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), *rest)
    lines = rows.select("_question", "copy", F.to_json(F.struct(*rest, "copy")).alias("line"))
    lines.mapInArrow(_singleton_files(root, question, str(uuid.uuid4())), "files bigint").agg(F.sum("files")).collect()
    open(f"{root}/_SUCCESS", "w").close()
