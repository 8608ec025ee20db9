"""Prompt, chat, preference, generation and log readers."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import GENERATIONS, STEP_LINE
from .folders import folder_name, folder_value, local_path

#: Lines that a task holds at once.
LINES = 8192


def read_prompts(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Parquet and JSON files together, one scan per format; any other suffix is an error.

    Without ``schema`` the files of a format are read once more to learn it.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    name = {p: p.rstrip("/").lower() for p in paths}
    parquet = [p for p in paths if name[p].endswith(".parquet")]
    json = [p for p in paths if name[p].endswith((".json", ".jsonl"))]
    other = [p for p in paths if p not in parquet and p not in json]
    if other:
        raise ValueError(f"unsupported file format: {other[0]}")
    reader = spark.read.schema(schema) if schema else spark.read
    parts = []
    if parquet:
        parts.append(reader.option("mergeSchema", schema is None).parquet(*parquet))
    if json:
        parts.append((spark.read.schema(schema) if schema else spark.read).json(json))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def _path(key: str, inner: Sequence[str] | None) -> Column:
    c = F.col(key)
    for k in inner or ():
        c = c.getField(k)
    return c


def read_sft(
    spark: SparkSession, paths: str | Sequence[str], prompt_key: str = "prompt", response_key: str = "response",
    prompt_dict_keys: Sequence[str] | None = None, response_dict_keys: Sequence[str] | None = None,
) -> DataFrame:
    """``prompt, response`` text, each from a column or a field path inside it (only those fields are read)."""
    d = read_prompts(spark, paths)
    return d.select(_path(prompt_key, prompt_dict_keys).alias("prompt"), _path(response_key, response_dict_keys).alias("response"))


def read_messages(
    spark: SparkSession, paths: str | Sequence[str], messages_key: str = "messages", tools_key: str = "tools",
    thinking_key: str = "enable_thinking",
) -> DataFrame:
    """``messages`` with ``tools`` and ``enable_thinking``, null where the files lack them."""
    d = read_prompts(spark, paths)
    pick = lambda k, n: (F.col(k) if k in d.columns else F.lit(None)).alias(n)
    rest = [c for c in d.columns if c not in (messages_key, tools_key, thinking_key)]
    return d.select(*rest, F.col(messages_key).alias("messages"), pick(tools_key, "tools"), pick(thinking_key, "enable_thinking"))


def read_preferences(spark: SparkSession, paths: str | Sequence[str], prompt="prompt", chosen="chosen", rejected="rejected") -> DataFrame:
    d = read_prompts(spark, paths)
    return d.select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))


def read_generations(spark: SparkSession, path: str, extra: T.StructType | None = None) -> DataFrame:
    """Generation dumps.  A file that does not carry ``step`` takes it from its ``<step>.jsonl`` name."""
    schema = T.StructType(GENERATIONS.fields + (extra.fields if extra else []))
    d = spark.read.schema(schema).json(path)
    named = F.regexp_extract(F.input_file_name(), r"(\d+)\.jsonl?$", 1).try_cast("long")
    return d.withColumn("step", F.coalesce("step", named))


def _singleton_lines(root: str, prefix: str, tasks: int):
    """Numbers of tasks to the lines of the folders that fall to each, with the values in the folders' names."""
    kinds = pa.schema([("question", pa.string()), ("split", pa.string()), ("line", pa.string())])

    def lines(task: int) -> Iterator[tuple[str | None, str | None, str]]:
        for folder in os.scandir(root):
            if folder.name.startswith(prefix) and crc32(folder.name.encode()) % tasks == task:
                for split in os.scandir(folder.path):
                    if split.name.startswith("split="):
                        for file in os.scandir(split.path):
                            if not file.name.startswith((".", "_")):
                                with open(file.path, encoding="utf-8", newline="\n") as text:
                                    yield from ((folder_value(folder.name), folder_value(split.name), line) for line in text if not line.isspace())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for task in (task for batch in batches for task in batch.column(0).to_pylist()):
            for row in lines(task):
                held.append(row)
                if len(held) == LINES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=kinds)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=kinds)

    return run


def read_singletons(spark: SparkSession, path: str, schema: T.StructType | str, question: str = "question_id") -> DataFrame:
    """All datasets that ``write_singletons`` wrote: their columns, the question and the split.

    In a local or mounted folder each task lists its share of the questions and
    reads their files; Spark's reader would first collect the names of all files.
    """
    root = local_path(spark, path)
    if root is None:
        return spark.read.schema(schema).json(path)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    lines = spark.range(tasks, numPartitions=tasks).mapInArrow(_singleton_lines(root, folder_name(question, "x")[:-1], tasks), "question string, split string, line string")
    fields = T.StructType([f for f in schema.fields if f.name not in (question, "split")])
    d = lines.select(F.from_json("line", fields).alias("r"), F.col("question").cast(schema[question].dataType).alias(question), "split")
    return d.select("r.*", question, "split")


# ---------------------------------------------------------------- console logs
def _items(line: str) -> Column:
    return F.split(F.col(line), " - ")


def parse_console_metrics(lines: DataFrame, line: str = "line") -> DataFrame:
    """``step:N - name:value - ...`` lines as ``(step, name, value)``; items that do not parse are left out."""
    d = lines.where(F.col(line).startswith("step")).select(F.posexplode(_items(line)).alias("no", "item"), F.col(line))
    head = F.split(F.element_at(_items(line), 1), ":")
    pair = F.split("item", ":")
    d = d.where((F.col("no") > 0) & (F.size(pair) == 2)).select(
        F.element_at(head, 2).try_cast("long").alias("step"), F.element_at(pair, 1).alias("name"),
        F.element_at(pair, 2).try_cast("double").alias("value"),
    )
    return d.where("value is not null")


def line_metric(name: str, line: str = "line") -> Column:
    """Value of one metric in a line; minus infinity if it is missing, unreadable, or behind an unreadable item."""
    items = _items(line)
    pairs = F.transform(items, lambda i: F.split(i, ":"))
    hit = F.array_position(F.transform(pairs, lambda p: F.get(p, F.lit(0)) == name), True)
    bad = F.array_position(F.transform(pairs, lambda p: F.size(p) != 2), True)
    value = F.try_element_at(F.try_element_at(pairs, hit.cast("int")), F.lit(2)).try_cast("double")
    ok = (hit > 0) & ((bad == 0) | (bad > hit))
    return F.when(ok, F.coalesce(value, F.lit(float("-inf")))).otherwise(F.lit(float("-inf")))


def best_metric(lines: DataFrame, name: str = "critic/rewards/mean", line: str = "line") -> DataFrame:
    """Largest value of one metric over all step lines."""
    return lines.where(F.col(line).startswith("step")).agg(F.max(line_metric(name, line)).alias("best"))


def read_step_metrics(lines: DataFrame, line: str = "line") -> DataFrame:
    """JSON step lines back to ``(step, name, value)``."""
    d = lines.select(F.from_json(line, STEP_LINE).alias("r"))
    return d.select("r.step", F.explode("r.data").alias("name", "value"))


# ---------------------------------------------------------------- nested values, vectors
def _flat(c: Column, kind: T.DataType, name: Column, sep: str) -> Column:
    entry = lambda n, v: F.struct(n.alias("key"), v.cast("string").alias("value"))
    join = lambda n: F.concat(name, F.lit(sep), n)
    if isinstance(kind, T.StructType):
        return F.concat(*[_flat(c.getField(f.name), f.dataType, join(F.lit(f.name)), sep) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        own = F.array(entry(join(F.lit("list_len")), F.size(c)))
        return F.concat(own, F.flatten(F.transform(c, lambda x, i: _flat(x, kind.elementType, join(i.cast("string")), sep))))
    if isinstance(kind, T.MapType):
        return F.flatten(F.transform(F.map_entries(c), lambda e: _flat(e["value"], kind.valueType, join(e["key"].cast("string")), sep)))
    return F.array(entry(name, c))


def flatten_params(df: DataFrame, keys: Sequence[str] = (), sep: str = "/") -> DataFrame:
    """Nested columns as ``(key, value)`` rows; a list gives ``list_len`` and one entry per index."""
    parts = [_flat(F.col(f.name), f.dataType, F.lit(f.name), sep) for f in df.schema.fields if f.name not in keys]
    return df.select(*keys, F.inline(F.concat(*parts)))


def attach_embeddings(df: DataFrame, embeddings: DataFrame, idx: str = "idx") -> DataFrame:
    """Adds ``embedding`` by row index; an empty array where there is none."""
    d = df.join(embeddings.select(idx, "embedding"), idx, "left")
    return d.withColumn("embedding", F.coalesce("embedding", F.array().cast("array<float>")))
