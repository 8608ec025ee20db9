"""Streams with state: what a micro-batch emits, restarts, late rows, and any split into micro-batches."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from rollframe.operators import validation as V
from rollframe.streaming import freshness as FR
from rollframe.streaming import metrics as SM

SCHEMA = "sample_id long, queue long, s long"


def land(spark, path, rows, schema=SCHEMA):
    """One more file."""
    d = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))
    d.coalesce(1).write.mode("append").parquet(path)
    return d.schema


def buffer(spark, at, schema, limit=5, **how):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in").withWatermark("ts", "5 seconds")
    FR.run_available(FR.bounded_buffer_stream(stream, limit, shards=2, **how), FR.batch_folder(f"{at}/out"), f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


def newest(rows, limit):
    out = {}
    for queue in {r[1] for r in rows}:
        own = sorted(((r[2], r[0]) for r in rows if r[1] == queue), reverse=True)[:limit]
        out[queue] = (len(own), sum(r[1] == queue for r in rows) - len(own), own[-1][1], own[0][1])
    return out


def state(changes, limit):
    return {r["queue"]: (r["buffered"], r["dropped"], r["oldest_id"], r["newest_id"]) for r in FR.merge_changes(changes, limit).collect()}


def test_buffer_emits_changes_only_and_goes_on_after_a_restart(spark, tmp_path):
    at = str(tmp_path)
    rows = [(i, 0 if i % 3 else 1, i) for i in range(300)]
    for low in (0, 100):
        schema = land(spark, f"{at}/in", rows[low : low + 100])
    got = buffer(spark, at, schema, 40)
    assert state(got, 40) == newest(rows[:200], 40)
    land(spark, f"{at}/in", rows[200:203])  # three more rows after a restart
    land(spark, f"{at}/in", rows[203:] + [(1000, 0, 1)])  # and one that comes too late to be among the newest
    got = buffer(spark, at, schema, 40)
    assert state(got, 40) == newest(rows + [(1000, 0, 1)], 40)
    sizes = {r["batch_id"]: r["count"] for r in got.groupBy("batch_id").count().collect()}
    third = sizes[sorted(sizes)[2]]  # batches without data emit nothing
    assert len(sizes) == 4 and third <= 6 and all(n <= 2 * 100 for n in sizes.values())
    assert [r["change"] for r in got.where("id = 1000").collect()] == ["drop"]


def test_buffer_expires_old_samples_and_refuses_late_ones(spark, tmp_path):
    at = str(tmp_path)
    schema = land(spark, f"{at}/in", [(i, 0, 1000 + i) for i in range(20)])
    land(spark, f"{at}/in", [(100, 0, 1060)])
    land(spark, f"{at}/in", [(101, 0, 1061), (7777, 0, 1002)])
    got = buffer(spark, at, schema, 50, max_age=timedelta(seconds=30))
    row = FR.merge_changes(got, 50).first()
    # the watermark stands at 1061 - 5 seconds: samples of more than 30 seconds before are gone
    assert row["expired"] == 20 and row["buffered"] == 2 and (row["oldest_id"], row["newest_id"], row["dropped"]) == (100, 101, 0)
    assert got.where("id = 7777").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_do_not_depend_on_the_split(spark, tmp_path, seed):
    rnd = random.Random(seed)
    schema = "sample_id long, response_len long"
    rows = [(i, rnd.randint(1, 500)) for i in range(107)]
    whole = FR.assemble_batches(spark.createDataFrame(rows, schema), 10, "sample_id", 2)
    want = sorted((r["sample_id"], r["batch_id"], r["complete"], r["part"]) for r in whole.collect())
    at, cuts = str(tmp_path), [0, *sorted(rnd.sample(range(1, 107), 3)), 107]
    for low, high in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[low:high], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        if rnd.random() < 0.6 or high == 107:  # stopped and started again
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
            FR.assemble_stream(stream, f"{at}/out", f"{at}/checkpoint", 10, "sample_id", 2)
    got = sorted((r["sample_id"], r["batch_id"], r["complete"], r["part"]) for r in FR.assembled_batches(spark, f"{at}/out").collect())
    assert got == want and sum(not r[2] for r in got) == 7


def test_a_micro_batch_that_runs_again_replaces_its_batches(spark, tmp_path):
    at, schema = str(tmp_path), "sample_id long, response_len long"
    spark.createDataFrame([(i, 5) for i in range(25)], schema).coalesce(1).write.parquet(f"{at}/in")
    run = lambda checkpoint: FR.assemble_stream(
        spark.readStream.schema(schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/{checkpoint}", 10, "sample_id")
    run("c1")
    first = sorted(map(tuple, FR.assembled_batches(spark, f"{at}/out").collect()))
    run("c2")  # the checkpoint was lost: micro-batch 0 is written anew
    assert sorted(map(tuple, FR.assembled_batches(spark, f"{at}/out").collect())) == first and len(first) == 25


def test_stale_totals_after_shuffled_arrival_and_restart(spark, tmp_path):
    rnd = random.Random(3)
    schema = "sample_id long, param_version long, param_version_end long"
    rows = [(i, v := rnd.randint(0, 5), v + rnd.randint(0, 2)) for i in range(200)]
    versions = spark.createDataFrame([(i, rnd.randint(2, 7)) for i in range(200)], "sample_id long, current_version long")
    rnd.shuffle(rows)
    at = str(tmp_path)
    for low in (0, 90, 95):
        high = {0: 90, 90: 95, 95: 200}[low]
        spark.createDataFrame(rows[low:high], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        FR.run_available(FR.stale_counts_stream(stream, versions), FR.batch_folder(f"{at}/out"), f"{at}/checkpoint", "update")
    got = sorted(map(tuple, FR.stale_totals(spark.read.parquet(f"{at}/out")).collect()))
    want = FR.stale_counts(spark.createDataFrame(rows, schema).join(versions, "sample_id"))
    assert got == sorted(map(tuple, want.select("current_version", "samples", "stale_samples", "stale_trajectories", "stale_samples_processed", "stale_trajectory_processed").collect()))


def test_whole_validation_of_a_stream(spark, tmp_path):
    rnd = random.Random(4)
    rows = [("s", i % 7, i, rnd.choice("AB"), rnd.random()) for i in range(90)]
    schema = "data_source string, uid long, traj_id long, pred string, score double"
    at = str(tmp_path)
    for part in (rows[::2], rows[1::4], rows[3::4]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    SM.stream_validation_counts(stream, ["score"], f"{at}/out", f"{at}/checkpoint")
    show = lambda m: {(r["var"], r["metric"]): r["value"] for r in m.collect()}
    d = spark.createDataFrame(rows, schema)
    want = V.counts_to_metrics(V.value_counts(V.melt_vars(d, ["score"])), V.vote_counts(d, ["score"]), 100)
    assert show(SM.merged_validation_counts(spark, f"{at}/out", 100)) == pytest.approx(show(want))
