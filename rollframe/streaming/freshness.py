"""Intake of rollouts, bounded buffers and staleness, as streams and as batch twins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.groups import number_rows, running_total
from ..operators.packing import balance_partitions


# ---------------------------------------------------------------- intake
def stream_rollouts(
    spark: SparkSession, path: str, schema: T.StructType, key: str = "traj_id", ts: str = "ts", delay: str = "1 hour",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Finished samples as they land in a folder; a sample delivered twice within the delay counts once."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, write, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, batch by batch, and stop.  ``write(batch, batch_id)`` must overwrite its own batch."""
    q = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


def batch_folder(path: str):
    """A ``foreachBatch`` sink with one folder per micro-batch: a batch that is run again replaces its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


# ---------------------------------------------------------------- bounded buffer
CHANGES = "queue long, shard long, id long, us long, change string"
_HELD = "us long, id long"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """List and value state need the RocksDB store; queries started from now on use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Buffer(StatefulProcessor):
    """The newest ``limit`` samples of one part of a queue in list state, oldest first; emits what changes."""

    def __init__(self, limit: int, max_age_us: int | None) -> None:
        self.limit, self.max_age_us = limit, max_age_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", _HELD)

    def _keep(self, held: list[tuple[int, int]]) -> None:
        if held:
            self.held.put(held)
        else:
            self.held.clear()

    def _changes(self, key, rows: dict[str, list[tuple[int, int]]]) -> Iterator[pd.DataFrame]:
        flat = [(key[0], key[1], i, us, change) for change, some in rows.items() for us, i in some]
        if flat:
            yield pd.DataFrame(flat, columns=["queue", "shard", "id", "us", "change"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(h) for h in self.held.get()] if self.held.exists() else []
        new = [pair for pdf in rows for pair in zip(pdf["us"].tolist(), pdf["id"].tolist())]
        held = sorted(before + new)
        gone, held = held[: max(0, len(held) - self.limit)], held[max(0, len(held) - self.limit) :]
        self._keep(held)
        if self.max_age_us is not None and held and (not before or held[0] != before[0]):
            self.handle.registerTimer((held[0][0] + self.max_age_us) // 1000 + 1)
        stays = set(held)
        yield from self._changes(key, {"put": [n for n in new if n in stays], "drop": gone})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(h) for h in self.held.get()] if self.held.exists() else []
        until = timerValues.getCurrentWatermarkInMs() * 1000
        old, held = [h for h in held if h[0] + self.max_age_us < until], [h for h in held if h[0] + self.max_age_us >= until]
        self._keep(held)
        if held:
            self.handle.registerTimer((held[0][0] + self.max_age_us) // 1000 + 1)
        yield from self._changes(key, {"expire": old})

    def close(self) -> None:
        pass


def bounded_buffer_stream(
    samples: DataFrame, limit: int, queue: str = "queue", ts: str = "ts", key: str = "sample_id", shards: int | None = None,
    max_age: timedelta | None = None,
) -> DataFrame:
    """Stateful buffer: the newest ``limit`` samples of a queue stay, older ones are dropped.

    A queue is kept as ``shards`` parts (as many as shuffle partitions) by a
    hash of its samples, so that a busy one runs in several tasks; each part
    holds at most ``limit`` samples, among which are all that the whole queue
    keeps.  Emits the changes of a micro-batch and nothing else: a sample that
    comes in (``put``), one that is pushed out or comes too late to be among the
    newest (``drop``) and, with ``max_age`` and a watermark on the stream, one
    that the watermark has passed by that much (``expire``).
    ``merge_changes`` gives the queues.
    """
    spark = samples.sparkSession
    keep_state_in_rocksdb(spark)
    parts = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = samples.select(
        F.col(queue).cast("long").alias("queue"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("long").alias("shard"),
        F.col(ts), F.unix_micros(ts).alias("us"), F.col(key).cast("long").alias("id"),
    )
    age = None if max_age is None else max_age // timedelta(microseconds=1)
    mode = "None" if age is None else "EventTime"
    return d.groupBy("queue", "shard").transformWithStateInPandas(Buffer(limit, age), CHANGES, "Append", mode)


def merge_changes(changes: DataFrame, limit: int) -> DataFrame:
    """Queues after the last micro-batch: ``buffered, dropped, expired, oldest_id, newest_id``.

    A sample's changes are counted, whatever their order; those of all parts
    that stay are cut to the newest ``limit``.
    """
    one = changes.groupBy("queue", "id", "us").agg(
        F.count_if(F.col("change") == "put").alias("put"), F.count_if(F.col("change") == "drop").alias("drop"), F.count_if(F.col("change") == "expire").alias("expire")
    )
    # a copy that was pushed out at once was never put
    one = one.withColumn("held", F.greatest(F.lit(0), F.col("put") - F.col("drop") - F.col("expire")))
    totals = one.groupBy("queue").agg(F.sum("expire").alias("expired"), F.sum("drop").alias("_dropped"), F.sum("held").alias("_held"))
    rank = F.row_number().over(W.partitionBy("queue").orderBy(F.desc("us"), F.desc("id")))
    kept = one.where("held > 0").withColumn("_age", rank).where(F.col("_age") <= limit)
    at = F.struct("us", "id")
    q = kept.groupBy("queue").agg(F.count(F.lit(1)).alias("buffered"), F.min_by("id", at).alias("oldest_id"), F.max_by("id", at).alias("newest_id"))
    buffered = F.coalesce("buffered", F.lit(0).cast("long"))
    return totals.join(q, "queue", "left").select(
        "queue", buffered.alias("buffered"), (F.col("_dropped") + F.col("_held") - buffered).alias("dropped"), "expired", "oldest_id", "newest_id"
    )


def bounded_buffer(samples: DataFrame, limit: int, point: Sequence[str], order: str) -> DataFrame:
    """Batch twin: of the samples between two consumption points the newest ``limit`` stay (``kept``), the others are dropped."""
    d = number_rows(samples, order, "_age", point, descending=True)
    return d.withColumn("kept", F.col("_age") <= limit).drop("_age")


def buffer_statistics(marked: DataFrame, point: Sequence[str]) -> DataFrame:
    return marked.groupBy(*point).agg(
        F.count(F.lit(1)).alias("produced"), F.count(F.when(F.col("kept"), 1)).alias("queue_size"),
        F.count(F.when(~F.col("kept"), 1)).alias("dropped"),
    )


# ---------------------------------------------------------------- staleness
def is_stale(current: Column, version: Column) -> Column:
    return (current - version) >= 1


def _stale(now: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("samples"),
        F.count(F.when(is_stale(now, F.col("param_version")), 1)).alias("stale_samples"),
        F.count(F.when(is_stale(now, F.col("param_version_end")), 1)).alias("stale_trajectories"),
    ]


def _with_totals(per: DataFrame, current: str) -> DataFrame:
    return running_total(per, [], current, {
        "stale_samples_processed": F.col("stale_samples"), "stale_trajectory_processed": F.col("stale_trajectories"),
    })


def stale_counts(samples: DataFrame, current: str = "current_version") -> DataFrame:
    """Per current version: stale samples (by start) and stale trajectories (by end version), and their running totals."""
    return _with_totals(samples.groupBy(current).agg(*_stale(F.col(current))), current)


def stale_counts_stream(samples: DataFrame, versions: DataFrame | None = None, key: str = "sample_id", current: str = "current_version") -> DataFrame:
    """Running counts per current version, as a stream in update mode: one row of state a version.

    ``versions`` (``key`` and ``current``) tells at which version a sample was
    consumed, where the samples don't.  ``stale_totals`` reads the output.
    """
    d = samples if versions is None else samples.join(versions, key)
    return d.groupBy(current).agg(*_stale(F.col(current)))


def stale_totals(updates: DataFrame, current: str = "current_version") -> DataFrame:
    """The newest counts of every version and their running totals, whatever order the samples came in."""
    return _with_totals(latest_updates(updates, [current]), current)


def latest_updates(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Update-mode output to its last row per key."""
    cols = [c for c in updates.columns if c not in keys and c != "batch_id"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_s")).select(*keys, "_s.*")


def mark_stale(stream: DataFrame, versions: DataFrame, key: str = "traj_id") -> DataFrame:
    """Stream-static join with the version each sample is consumed at (``key, current_version``)."""
    d = stream.join(versions, key)
    return d.withColumn("stale", is_stale(F.col("current_version"), F.col("param_version")))


def partial_rollout_stats(samples: DataFrame) -> DataFrame:
    """Rollouts that span versions: number, ratio, widest span; and how many versions took part."""
    span = F.abs(F.col("param_version_end") - F.col("param_version_start"))
    return samples.agg(
        F.count(F.when(span > 0, 1)).alias("total_partial_num"), F.avg(F.when(span > 0, 1.0).otherwise(0.0)).alias("partial_ratio"),
        F.max(span).alias("max_partial_span"), F.count_distinct("param_version").alias("param_version_diversity"),
    )


def staleness_limit(required: int, threshold: float, sync_every: int) -> int:
    """Samples a version may produce before generation has to wait."""
    return int(required * (threshold + 1) * sync_every)


def staleness_gate(counts: DataFrame, required: int, threshold: float, sync_every: int) -> DataFrame:
    """Decision per version from ``buffered, in_flight, queue_size``: the limit, and whether to pause and why."""
    limit = staleness_limit(required, threshold, sync_every)
    full, stale = F.col("queue_size") >= limit, F.col("buffered") + F.col("in_flight") >= limit
    return counts.withColumn("max_required", F.lit(limit).cast("long")).withColumn("pause", full | stale).withColumn(
        "reason", F.when(full, "queue full").when(stale, "stale samples")
    )


def idle_ratio(versions: DataFrame) -> DataFrame:
    """Per version (``version, started, idle_from, produced, consumed``, seconds): active and total time, idle share, rates.

    One row per version: the series of versions of a run is short.
    """
    end = F.lead("started").over(W.partitionBy("run").orderBy("version"))
    d = versions.withColumn("version_time", end - F.col("started")).where("version_time is not null")
    d = d.withColumn("active_time", F.col("idle_from") - F.col("started"))
    return d.withColumns({
        "idle_ratio": 1 - F.col("active_time") / F.col("version_time"),
        "produced_rate": F.col("produced") / F.col("version_time"),
        "consumed_rate": F.col("consumed") / F.col("version_time"),
    })


# ---------------------------------------------------------------- batches from the stream
def assemble_batches(samples: DataFrame, require: int, order: str, workers: int = 1, length: str = "response_len") -> DataFrame:
    """Samples in arrival order cut into batches of ``require``, each balanced over the workers by length (``part``).

    A last incomplete batch waits (``complete`` is false, no part);
    ``assemble_stream`` carries it on.
    """
    d = number_rows(samples, order, "_rn").withColumn("batch_id", F.expr(f"(_rn - 1) div {int(require)}")).drop("_rn")
    rows = samples.agg(F.count(F.lit(1))).scalar()
    d = d.withColumn("_rows", rows).withColumn("complete", (F.col("batch_id") + 1) * require <= F.col("_rows")).drop("_rows")
    ready = balance_partitions(d.where("complete"), workers, length, "batch_id", order, equal_size=require % workers == 0)
    return ready.unionByName(d.where("NOT complete").withColumn("part", F.lit(None).cast("long")))


def assemble_stream(
    samples: DataFrame, path: str, checkpoint: str, require: int, order: str, workers: int = 1, length: str = "response_len"
) -> None:
    """``assemble_batches`` over a stream: rows left over by a micro-batch wait for the next, and batch numbers go on.

    Each micro-batch writes what it assembled, and the rows that wait, to
    ``path/assembled/micro=<n>`` and then the next batch number to
    ``path/state/micro=<n>``.  It starts from the newest state of an earlier
    micro-batch, so one that is run again after a loss replaces its own rows and
    every batch exists exactly once.  Samples that come in ``order`` make the
    same batches however they are split.  ``assembled_batches`` reads the result.
    """
    spark = samples.sparkSession
    state = spark.createDataFrame([(0,)], "next long")
    state.write.mode("ignore").parquet(f"{path}/state/micro=-1")

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        last = own.read.parquet(f"{path}/state").where(F.col("micro") < number).orderBy(F.desc("micro")).first()
        rows = batch
        if last["micro"] >= 0:
            before = own.read.parquet(f"{path}/assembled/micro={last['micro']}")
            rows = before.where("NOT complete").select(*batch.columns).unionByName(batch)
        done = assemble_batches(rows, require, order, workers, length).withColumn("batch_id", F.col("batch_id") + F.lit(last["next"]))
        done.write.mode("overwrite").parquet(f"{path}/assembled/micro={number}")
        written = own.read.schema(done.schema).parquet(f"{path}/assembled/micro={number}")
        after = written.agg(F.coalesce(F.max(F.when(F.col("complete"), F.col("batch_id"))) + 1, F.lit(last["next"])).cast("long").alias("next"))
        after.write.mode("overwrite").parquet(f"{path}/state/micro={number}")

    run_available(samples, write, checkpoint)


def assembled_batches(spark: SparkSession, path: str) -> DataFrame:
    """The batches that are complete and, as ``complete`` = false, the rows that wait after the newest micro-batch."""
    rows = spark.read.parquet(f"{path}/assembled")
    newest = spark.read.parquet(f"{path}/state").agg(F.max("micro")).scalar()
    return rows.where(F.col("complete") | (F.col("micro") == newest)).drop("micro")


def batch_statistics(assembled: DataFrame) -> DataFrame:
    """What travels with a batch: tokens, time and version statistics, and tool times where ``tool_calls_time`` is given."""
    span = F.abs(F.col("param_version_end") - F.col("param_version_start"))
    time = F.col("processing_time")
    tools = []
    if "tool_calls_time" in assembled.columns:
        tools = [f("tool_calls_time").alias(f"tool_calls_{n}") for n, f in (("max", F.max), ("min", F.min), ("mean", F.avg))]
    return assembled.where("complete").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("response_len").alias("tokens"),
        F.avg(time).alias("processing_time_avg"), F.max(time).alias("processing_time_max"), F.min(time).alias("processing_time_min"),
        *[F.percentile(time, F.lit(p / 100)).alias(f"processing_time_tp{p}") for p in (50, 95, 99)], *tools,
        F.count(F.when(span > 0, 1)).alias("total_partial_num"), F.avg(F.when(span > 0, 1.0).otherwise(0.0)).alias("partial_ratio"),
        F.max(span).alias("max_partial_span"), F.count_distinct("param_version").alias("param_version_diversity"),
    )
