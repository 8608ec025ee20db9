"""Checks of streams and their batch twins, and of the whole jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.exprs import r6, rounded
from ..operators import registry as G
from ..operators.offpolicy import rejection_rules
from ..operators.validation import melt_vars
from ..plans import lifecycle as P
from ..plans.views import rollouts, table, tokens
from ..session import shared_dir
from ..streaming import freshness as FR
from ..streaming import metrics as SM
from .batch import part_checks
from .metrics import AGG_CASE, BW, MAJ, MS, PLACES, REP, SA, SM as STEP_SQL, places, step_metrics
from .oracle import CATALOG as C

DAY = "CAST(dayofmonth(ts) AS BIGINT)"


def home(spark):
    return f"{shared_dir(spark).rstrip('/')}/rollframe-{uuid.uuid4().hex}"


def samples(spark, sf):
    """Events as finished samples: the version is the day they started on."""
    day = F.dayofmonth("ts").cast("long")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("sample_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 16).alias("queue"), day.alias("param_version"), day.alias("param_version_start"),
        (day + F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "click", 1).otherwise(0)).alias("param_version_end"),
        (day + F.col("user_id") % 3).alias("current_version"), F.col("value").alias("processing_time"),
        F.length("props").cast("long").alias("response_len"))


SP = f""", sp AS (SELECT event_id AS sample_id, ts, user_id%16 AS queue, {DAY} AS param_version, {DAY} AS v0,
   {DAY}+CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS v1, {DAY}+user_id%3 AS current_version, value AS processing_time, length(props) AS response_len FROM events)
"""


def landed(spark, sf, path, files=4):
    """Samples written as several files, as a producer would."""
    d = samples(spark, sf)
    d.repartitionByRange(files, "ts").write.parquet(path)
    return d.schema


@C.add("stream_rollouts", SP + "SELECT sample_id, queue, param_version FROM sp")
def _(spark, sf):
    at = home(spark)
    schema = landed(spark, sf, f"{at}/in")
    # the same samples delivered a second time count once
    spark.read.parquet(f"{at}/in").write.mode("append").parquet(f"{at}/in")
    stream = FR.stream_rollouts(spark, f"{at}/in", schema, "sample_id", "ts", "60 days")
    FR.run_available(stream, FR.batch_folder(f"{at}/out"), f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").select("sample_id", "queue", "param_version")


@C.add("bounded_buffer_stream", SP + """, r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ts DESC, sample_id DESC) AS age, count(*) OVER (PARTITION BY queue) AS n FROM sp)
SELECT queue, least(any_value(n),50) AS buffered, greatest(any_value(n)-50,0) AS dropped, max(CASE WHEN age=least(n,50) THEN sample_id END) AS oldest_id, max(CASE WHEN age=1 THEN sample_id END) AS newest_id FROM r GROUP BY queue""")
def _(spark, sf):
    at = home(spark)
    schema = landed(spark, sf, f"{at}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    FR.run_available(FR.bounded_buffer_stream(stream, 50, shards=4), FR.batch_folder(f"{at}/out"), f"{at}/checkpoint")
    return FR.merge_changes(spark.read.parquet(f"{at}/out"), 50).drop("expired")


C.add("bounded_buffer", SP + "SELECT sample_id, param_version, row_number() OVER (PARTITION BY queue, param_version ORDER BY sample_id DESC)<=10 AS kept FROM sp")(
    lambda spark, sf: FR.bounded_buffer(samples(spark, sf), 10, ["queue", "param_version"], "sample_id").select("sample_id", "param_version", "kept"))
C.add("buffer_statistics", SP + ", k AS (SELECT queue, param_version, count(*) AS n FROM sp GROUP BY ALL) SELECT queue, param_version, n AS produced, least(n,10) AS queue_size, greatest(n-10,0) AS dropped FROM k")(
    lambda spark, sf: FR.buffer_statistics(FR.bounded_buffer(samples(spark, sf), 10, ["queue", "param_version"], "sample_id"), ["queue", "param_version"]))
STALE = SP + """, c AS (SELECT current_version, count(*) AS samples, count(*) FILTER (current_version-param_version>=1) AS stale_samples, count(*) FILTER (current_version-v1>=1) AS stale_trajectories FROM sp GROUP BY 1)
SELECT *, CAST(sum(stale_samples) OVER (ORDER BY current_version) AS BIGINT) AS stale_samples_processed, CAST(sum(stale_trajectories) OVER (ORDER BY current_version) AS BIGINT) AS stale_trajectory_processed FROM c"""
C.add("stale_counts", STALE)(lambda spark, sf: FR.stale_counts(samples(spark, sf)))


@C.add("stale_counts_stream", STALE)
def _(spark, sf):
    """Samples in any order, the stream stopped and started again in between."""
    at = home(spark)
    d = samples(spark, sf)
    versions = d.select("sample_id", "current_version")
    for part in range(3):
        d.where(F.pmod(F.xxhash64("sample_id"), F.lit(3)) == part).drop("current_version").repartition(2, "sample_id").write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(d.drop("current_version").schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        FR.run_available(FR.stale_counts_stream(stream, versions), FR.batch_folder(f"{at}/out"), f"{at}/checkpoint", "update")
    return FR.stale_totals(spark.read.parquet(f"{at}/out"))


@C.add("mark_stale", SP + "SELECT sample_id, current_version-param_version>=1 AS stale FROM sp")
def _(spark, sf):
    at = home(spark)
    schema = landed(spark, sf, f"{at}/in")
    stream = spark.readStream.schema(schema).parquet(f"{at}/in").drop("current_version")
    marked = FR.mark_stale(stream, samples(spark, sf).select("sample_id", "current_version"), "sample_id")
    FR.run_available(marked, FR.batch_folder(f"{at}/out"), f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").select("sample_id", "stale")


C.add("partial_rollout_stats", SP + """SELECT count(*) FILTER (v1<>v0) AS total_partial_num, round(avg(CASE WHEN v1<>v0 THEN 1 ELSE 0 END),6)+0e0 AS partial_ratio, max(v1-v0) AS max_partial_span,
  count(DISTINCT param_version) AS param_version_diversity FROM sp""")(
    lambda spark, sf: rounded(FR.partial_rollout_stats(samples(spark, sf)), "total_partial_num", "max_partial_span", "param_version_diversity", partial_ratio="partial_ratio"))


@C.add("staleness_gate", SP + """, c AS (SELECT param_version, count(*) FILTER (v1=v0) AS buffered, count(*) FILTER (v1>v0) AS in_flight, count(*) FILTER (queue<12) AS queue_size FROM sp GROUP BY 1)
SELECT *, CAST(330 AS BIGINT) AS max_required, queue_size>=330 OR buffered+in_flight>=330 AS pause, CASE WHEN queue_size>=330 THEN 'queue full' WHEN buffered+in_flight>=330 THEN 'stale samples' END AS reason FROM c""")
def _(spark, sf):
    span = F.col("param_version_end") > F.col("param_version_start")
    c = samples(spark, sf).groupBy("param_version").agg(
        F.count(F.when(~span, 1)).alias("buffered"), F.count(F.when(span, 1)).alias("in_flight"), F.count(F.when(F.col("queue") < 12, 1)).alias("queue_size"))
    return FR.staleness_gate(c, 44, 1.5, 3)


@C.add("idle_ratio", SP + """, v AS (SELECT queue AS run, param_version AS version, min(epoch_us(ts))/1000000 AS started, max(epoch_us(ts))/1000000 AS idle_from, count(*) AS produced, count(*) FILTER (v1=v0) AS consumed FROM sp GROUP BY ALL),
  d AS (SELECT *, lead(started) OVER (PARTITION BY run ORDER BY version)-started AS version_time, idle_from-started AS active_time FROM v)
SELECT run, version, round(version_time,3)+0e0 AS version_time, round(active_time,3)+0e0 AS active_time, round(1-active_time/version_time,6)+0e0 AS idle_ratio,
  round(produced/version_time,6)+0e0 AS produced_rate, round(consumed/version_time,6)+0e0 AS consumed_rate FROM d WHERE version_time IS NOT NULL""")
def _(spark, sf):
    s = samples(spark, sf)
    us = F.unix_micros("ts") / 1000000
    v = s.groupBy(F.col("queue").alias("run"), F.col("param_version").alias("version")).agg(
        F.min(us).alias("started"), F.max(us).alias("idle_from"), F.count(F.lit(1)).alias("produced"),
        F.count(F.when(F.col("param_version_end") == F.col("param_version_start"), 1)).alias("consumed"))
    d = FR.idle_ratio(v)
    return d.select("run", "version", (F.round("version_time", 3) + 0.0).alias("version_time"), (F.round("active_time", 3) + 0.0).alias("active_time"),
                    *[r6(c).alias(c) for c in ("idle_ratio", "produced_rate", "consumed_rate")])


def assembled(spark, sf):
    d = samples(spark, sf).withColumn("tool_calls_time", F.col("response_len") / 8)
    return FR.assemble_batches(d, 96, "sample_id", 4)


AB = SP + """, b AS (SELECT *, (row_number() OVER (ORDER BY sample_id)-1)//96 AS batch_id, count(*) OVER () AS n FROM sp)
"""
C.add("assemble_batches", AB + """SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(4 AS BIGINT) AS parts, CAST(24 AS BIGINT) AS fewest, CAST(24 AS BIGINT) AS most, CAST(sum(response_len) AS BIGINT) AS total,
  true AS even, true AS from_zero, CAST(4 AS BIGINT) AS numbers, count(*) AS n_rows, count(*) AS n_ids FROM b WHERE (batch_id+1)*96<=n GROUP BY batch_id""")(
    lambda spark, sf: part_checks(assembled(spark, sf).where("complete").withColumnRenamed("sample_id", "traj_id"), "response_len"))
C.add("assemble_batches_rows", AB + "SELECT sample_id, CAST(batch_id AS BIGINT) AS batch_id, (batch_id+1)*96<=n AS complete, (batch_id+1)*96>n AS waits FROM b")(
    lambda spark, sf: assembled(spark, sf).select("sample_id", "batch_id", "complete", F.col("part").isNull().alias("waits")))
@C.add("assemble_stream_rows", AB + "SELECT sample_id, CAST(batch_id AS BIGINT) AS batch_id, (batch_id+1)*96<=n AS complete, (batch_id+1)*96>n AS waits FROM b")
def _(spark, sf):
    """Uneven files, one a micro-batch, with a stop in between: the batches are those of the whole table."""
    at = home(spark)
    d = samples(spark, sf)
    cuts = [0, 50, 51, 700, 10_000, 1 << 60]
    for low, high in zip(cuts, cuts[1:]):
        d.where(F.col("sample_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(f"{at}/in")
        if high in (51, cuts[-1]):
            stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
            FR.assemble_stream(stream, f"{at}/out", f"{at}/checkpoint", 96, "sample_id", 4)
    return FR.assembled_batches(spark, f"{at}/out").select("sample_id", "batch_id", "complete", F.col("part").isNull().alias("waits"))


C.add("batch_statistics", AB + """SELECT CAST(batch_id AS BIGINT) AS batch_id, count(*) AS samples, CAST(sum(response_len) AS BIGINT) AS tokens, round(avg(processing_time),8)+0e0 AS processing_time_avg, round(max(processing_time),6)+0e0 AS processing_time_max,
  round(min(processing_time),6)+0e0 AS processing_time_min, round(quantile_cont(processing_time,0.5),5)+0e0 AS processing_time_tp50, round(quantile_cont(processing_time,0.95),5)+0e0 AS processing_time_tp95,
  round(quantile_cont(processing_time,0.99),5)+0e0 AS processing_time_tp99, max(response_len/8)+0e0 AS tool_calls_max, min(response_len/8)+0e0 AS tool_calls_min, round(avg(response_len/8),8)+0e0 AS tool_calls_mean,
  count(*) FILTER (v1<>v0) AS total_partial_num, round(avg(CASE WHEN v1<>v0 THEN 1 ELSE 0 END),6)+0e0 AS partial_ratio, max(v1-v0) AS max_partial_span, count(DISTINCT param_version) AS param_version_diversity
FROM b WHERE (batch_id+1)*96<=n GROUP BY batch_id""")(
    # a 96th of a two-decimal sum may sit on a tie at six places, so means keep eight
    lambda spark, sf: rounded(
        FR.batch_statistics(assembled(spark, sf)), "batch_id", "samples", "tokens", "total_partial_num", "max_partial_span", "param_version_diversity", "tool_calls_max", "tool_calls_min",
        *[(F.round(c, 8) + 0.0).alias(c) for c in ("processing_time_avg", "tool_calls_mean")],
        *[(F.round(c, 5) + 0.0).alias(c) for c in ("processing_time_tp50", "processing_time_tp95", "processing_time_tp99")],
        **{c: c for c in ("processing_time_max", "processing_time_min", "partial_ratio")}))

VN = STEP_SQL + ", vn AS (SELECT step//1000 AS param_version, step, name, value FROM sn)\n"


def version_metrics(spark, sf):
    return step_metrics(spark, sf).withColumn("param_version", F.expr("step div 1000"))


@C.add("streaming_step_metrics", VN + """SELECT CAST(param_version AS BIGINT) AS param_version, name, round(sum(value),6)+0e0 AS total, count(*) AS n, round(max(value),6)+0e0 AS high, round(min(value),6)+0e0 AS low,
  round(arg_max(value, step),6)+0e0 AS last FROM vn GROUP BY ALL""")
def _(spark, sf):
    at = home(spark)
    # a step a second; files may land in any order, so none of them is late
    m = version_metrics(spark, sf).withColumn("ts", F.timestamp_seconds("step"))
    m.repartitionByRange(4, "step").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    FR.run_available(SM.streaming_step_metrics(stream, delay="3650 days"), FR.batch_folder(f"{at}/out"), f"{at}/checkpoint", "update")
    last = SM.latest_updates(spark.read.parquet(f"{at}/out"), ["param_version", "name", "span"])
    return rounded(SM.merge_spans(last), "param_version", "name", "n", total="total", high="high", low="low", last="last")


C.add("step_metrics_by_version", VN + f""", ag AS (SELECT param_version, name, {AGG_CASE} AS v FROM vn GROUP BY param_version, name),
  g AS (SELECT param_version, max(v) FILTER (name='global_seqlen/max') AS gmax, max(v) FILTER (name='global_seqlen/min') AS gmin, max(v) FILTER (name='perf/total_num_tokens') AS tok,
    max(v) FILTER (name='perf/time_per_step') AS sec, max(v) FILTER (name='timing_s/gen') AS gen, max(v) FILTER (name='timing_s/step') AS stp FROM ag GROUP BY 1)
SELECT CAST(param_version AS BIGINT) AS param_version, name, round(CASE name WHEN 'global_seqlen/minmax_diff' THEN gmax-gmin WHEN 'perf/throughput' THEN tok/(sec*16) ELSE v END,6)+0e0 AS value FROM ag JOIN g USING (param_version)
UNION ALL SELECT CAST(param_version AS BIGINT), 'trainer/idle_ratio', round(gen/stp,6)+0e0 FROM g""")(
    lambda spark, sf: rounded(SM.step_metrics_by_version(version_metrics(spark, sf), 16), "param_version", "name", value="value"))


@C.add("incremental_validation_stream", SA + f"SELECT data_source, var, metric, round(v,6)+0e0 AS value FROM {MS}")
def _(spark, sf):
    at = home(spark)
    s = melt_vars(rollouts(spark, sf), ["score", "acc"])
    s.repartition(3).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    SM.stream_validation(stream, f"{at}/out", f"{at}/checkpoint")
    return rounded(SM.merged_validation(spark, f"{at}/out"), "data_source", "var", "metric", value="value")


@C.add("incremental_validation_counts_stream", SA + BW + MAJ + f""", al AS (SELECT * FROM {MS} UNION ALL SELECT data_source, var, metric, avg(v) FROM u GROUP BY ALL UNION ALL SELECT * FROM mj)
SELECT data_source, var, metric, {PLACES}+0e0 AS value FROM al""")
def _(spark, sf):
    at = home(spark)
    r = rollouts(spark, sf).select("data_source", "uid", "traj_id", "pred", "score", "acc")
    # three micro-batches of four files: their number doesn't bound the tasks that write and read them
    r.repartition(12, "traj_id").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/in")
    SM.stream_validation_counts(stream, ["score", "acc"], f"{at}/out", f"{at}/checkpoint")
    return places(SM.merged_validation_counts(spark, f"{at}/out"))


@C.add("stream_rollouts_late", SP + "SELECT sample_id, queue, param_version FROM sp WHERE NOT (param_version<=3 AND sample_id%5=0)")
def _(spark, sf):
    """A short delay: a fifth of the first three days comes after everything else, and is refused."""
    at = home(spark)
    d = samples(spark, sf)
    late = (F.col("param_version") <= 3) & (F.col("sample_id") % 5 == 0)
    for part in (d.where(~late & (F.col("param_version") <= 15)), d.where(~late & (F.col("param_version") > 15)), d.where(late)):
        part.coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = FR.stream_rollouts(spark, f"{at}/in", d.schema, "sample_id", "ts", "1 hour", files_per_trigger=1)
    FR.run_available(stream, FR.batch_folder(f"{at}/out"), f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").select("sample_id", "queue", "param_version")


@C.add("streaming_step_metrics_late", VN + """SELECT CAST(param_version AS BIGINT) AS param_version, name, round(sum(value),6)+0e0 AS total, count(*) AS n, round(max(value),6)+0e0 AS high, round(min(value),6)+0e0 AS low,
  round(arg_max(value, step),6)+0e0 AS last FROM vn WHERE NOT (step<(SELECT max(step)//4 FROM vn) AND step%3=0) GROUP BY ALL""")
def _(spark, sf):
    """A short delay: spans behind the watermark leave the state, and a third of the first quarter's steps, which comes last, is refused."""
    at = home(spark)
    m = version_metrics(spark, sf).withColumn("ts", F.timestamp_seconds("step"))
    m = m.withColumn("_top", m.agg(F.max("step")).scalar())
    late = (F.col("step") < F.expr("_top div 4")) & (F.col("step") % 3 == 0)
    for part in (m.where(~late & F.expr("step < _top div 2")), m.where(~late & F.expr("step >= _top div 2")), m.where(late)):
        part.drop("_top").coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(m.drop("_top").schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    FR.run_available(SM.streaming_step_metrics(stream, span="1 second", delay="1 second"), FR.batch_folder(f"{at}/out"), f"{at}/checkpoint", "update")
    last = SM.latest_updates(spark.read.parquet(f"{at}/out"), ["param_version", "name", "span"])
    return rounded(SM.merge_spans(last), "param_version", "name", "n", total="total", high="high", low="low", last="last")


@C.add("register_generator", "SELECT doc_id FROM documents UNION ALL (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 1)")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    G.GENERATORS.pop("first", None)
    G.register_generator("first", G.first_row_again("doc_id"))
    return G.generate_after_batch(d, "first", 1 << 40, F.col("n_chars")).select("doc_id")


# ---------------------------------------------------------------- whole jobs
C.add("training_step", """, k AS (SELECT *, CASE WHEN mask=1 THEN greatest(least(exp(greatest(least(ref_logp-old_logp,20),-20))-greatest(least(ref_logp-old_logp,20),-20)-1,10),-10) ELSE 0 END AS kld FROM tokens),
  r AS (SELECT *, token_reward-0.01*kld AS rew, rollout_logp-old_logp AS k1 FROM k), s AS (SELECT uid, traj_id, sum(rew) AS score FROM r GROUP BY ALL),
  g AS (SELECT traj_id, CASE WHEN count(*) OVER g=1 THEN score/(1+1e-6) ELSE (score-avg(score) OVER g)/(stddev_samp(score) OVER g+1e-6) END AS a FROM s WINDOW g AS (PARTITION BY uid))
SELECT traj_id, t, CASE WHEN k1>=ln(0.5) AND k1<=ln(2.0) THEN mask ELSE 0 END AS mask, round(least(exp(-k1)*mask,2),6)+0e0 AS is_weight,
  round(a*CASE WHEN k1>=ln(0.5) AND k1<=ln(2.0) THEN mask ELSE 0 END,6)+0e0 AS advantage FROM r JOIN g USING (traj_id)""")(
    lambda spark, sf: rounded(P.training_step(tokens(spark, sf), rejection_rules("token_k1", 2.0), 0.01), "traj_id", "t", "mask",
                              is_weight="is_weight", advantage="advantage"))
# a thousand draws over few prompts lie on ties at six places, and a deviation is known to fewer places than a mean
C.add("evaluate", SA + BW + MAJ + REP.format(ms=f"(SELECT * FROM {MS} UNION ALL SELECT * FROM mj)").replace(
    "round(v,6)", "CASE WHEN metric LIKE '%std%' THEN round(v,6) ELSE round(v,10) END"))(
    lambda spark, sf: P.evaluate(rollouts(spark, sf)).select(
        "name", (F.when(F.col("name").contains("std"), F.round("value", 6)).otherwise(F.round("value", 10)) + 0.0).alias("value")))


@C.add("build_prompt_table", """, l AS (SELECT doc_id, lang, text, n_chars, row_number() OVER (ORDER BY doc_id)-1 AS idx, len(list_filter(regexp_split_to_array(text,'\\s+'), lambda w: w<>'')) AS words FROM documents)
SELECT lang AS data_source, CAST(idx AS VARCHAR) AS idx, CASE WHEN CAST('0x'||substr(md5(idx||'|42'),1,8) AS BIGINT)/4294967296e0<0.2 THEN 'test' ELSE 'train' END AS split,
  text||chr(10)||chr(10)||'Please reason step by step, and put your final answer within \\boxed{}.' AS content, CAST(n_chars AS VARCHAR) AS truth FROM l WHERE words+11<=800""")
def _(spark, sf):
    raw = table(spark, sf, "documents").select(
        "doc_id", F.lit("math").alias("kind"), F.col("lang").alias("dataset"), F.col("text").alias("problem"), F.col("text").alias("description"),
        F.col("n_chars").alias("answer"))
    return P.build_prompt_table(raw, "corpus", "doc_id", 0.2, 800).select(
        "data_source", F.col("extra_info.index").alias("idx"), F.col("extra_info.split").alias("split"), F.col("prompt")[0]["content"].alias("content"),
        F.col("reward_model.ground_truth").alias("truth"))
