"""Checks of run metrics, validation statistics and demonstrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import r6, rounded
from ..operators import demos as D
from ..operators import run_metrics as R
from ..operators import validation as V
from ..operators.advantages import adv_grpo, spread_to_tokens
from ..plans.views import rollouts, table, tokens
from .oracle import CATALOG as C


def nv(df):
    return rounded(df, "name", value="value")


def long_sql(pairs, source):
    """(name, expression) pairs over one source as long rows."""
    return "\nUNION ALL ".join(f"SELECT '{n}' AS name, round({e},6)+0e0 AS value FROM {source}" for n, e in pairs)


def with_lengths(spark, sf):
    r = rollouts(spark, sf)
    return r.withColumns({
        "prompt_len": F.col("traj_id") % 100 + 1, "num_turns": F.col("traj_id") % 4, "tool_calls": F.col("traj_id") % 3,
        "gen_time": (F.col("traj_id") % 1009) / 10.0, "tool_time": (F.col("traj_id") % 53) / 10.0,
    })


RL = """, rl AS (SELECT *, traj_id % 100 + 1 AS prompt_len, traj_id % 4 AS num_turns, traj_id % 3 AS tool_calls,
        (traj_id % 1009)/10e0 AS gen_time, (traj_id % 53)/10e0 AS tool_time FROM rollouts)
"""


def three(p, e, cond, of=("mean", "max", "min")):
    fn = {"mean": "avg", "max": "max", "min": "min"}
    return [(f"{p}/{k}", f"{fn[k]}({e}) FILTER ({cond})") for k in of]


def data_metric_tokens(spark, sf):
    t = tokens(spark, sf).withColumn("token_score", F.col("token_reward"))
    t = t.withColumn("token_reward", F.col("token_score") - 0.01 * F.col("value"))
    return spread_to_tokens(t, adv_grpo(rollouts(spark, sf), norm_by_std=False))


C.add("data_metrics", RL + """, ga AS (SELECT traj_id, score - CASE WHEN count(*) OVER g = 1 THEN 0 ELSE avg(score) OVER g END AS a
        FROM rollouts WINDOW g AS (PARTITION BY uid)),
  tk AS (SELECT tokens.*, a AS adv, token_reward-0.01*value AS rew FROM tokens JOIN ga USING (traj_id)),
  sq AS (SELECT traj_id, sum(token_reward) AS s, sum(rew) AS r FROM tk GROUP BY traj_id),
  rr AS (SELECT rl.*, s, r FROM rl LEFT JOIN sq USING (traj_id))
""" + long_sql(
    three("critic/advantages", "adv", "mask=1") + three("critic/returns", "adv", "mask=1") + three("critic/values", "value", "mask=1")
    + [("critic/vf_explained_var", "1-var_samp(adv-value) FILTER (mask=1)/(var_samp(adv) FILTER (mask=1)+1e-5)")], "tk")
    + "\nUNION ALL " + long_sql(
    three("critic/score", "s", "response_len>0") + three("critic/rewards", "r", "response_len>0")
    + three("response_length", "response_len", "true")
    + [("response_length/clip_ratio", "avg(CASE WHEN response_len=7 THEN 1 ELSE 0 END)")]
    + three("response_length_non_aborted", "response_len", "response_len>0")
    + [("response_length_non_aborted/clip_ratio", "avg(CASE WHEN response_len=7 THEN 1 ELSE 0 END) FILTER (response_len>0)"),
       ("response/aborted_ratio", "avg(CASE WHEN response_len=0 THEN 1 ELSE 0 END)")]
    + three("prompt_length", "prompt_len", "true")
    + [("prompt_length/clip_ratio", "avg(CASE WHEN prompt_len=100 THEN 1 ELSE 0 END)")]
    + three("num_turns", "num_turns", "true") + three("tool_call_counts", "tool_calls", "true"), "rr"))(
    lambda spark, sf: nv(R.data_metrics(data_metric_tokens(spark, sf), with_lengths(spark, sf), 7, 100)))

ST = """, st AS (SELECT CASE event_type WHEN 'view' THEN 'gen' WHEN 'click' THEN 'ref' WHEN 'error' THEN 'values' WHEN 'purchase' THEN 'step' ELSE 'reward' END AS stage,
        sum(value) AS seconds FROM events GROUP BY 1),
  tt AS (SELECT sum(response_len) AS resp, sum(prompt_len+response_len) AS alltok FROM rl)
"""


def stages(spark, sf):
    name = (F.when(F.col("event_type") == "view", "gen").when(F.col("event_type") == "click", "ref")
            .when(F.col("event_type") == "error", "values").when(F.col("event_type") == "purchase", "step").otherwise("reward"))
    return table(spark, sf, "events").groupBy(name.alias("stage")).agg(F.sum("value").alias("seconds"))


C.add("timing_metrics", RL + ST + """
SELECT 'timing_s/'||stage AS name, round(seconds,6)+0e0 AS value FROM st
UNION ALL SELECT 'timing_per_token_ms/'||stage, round(seconds*1000/CASE stage WHEN 'gen' THEN resp ELSE alltok END,6)+0e0 FROM st, tt WHERE stage IN ('gen','ref','values')""")(
    lambda spark, sf: nv(R.timing_metrics(stages(spark, sf), with_lengths(spark, sf))))
C.add("throughput_metrics", RL + ST + """
SELECT 'perf/total_num_tokens' AS name, alltok+0e0 AS value FROM tt
UNION ALL SELECT 'perf/time_per_step', round(seconds,6)+0e0 FROM st WHERE stage='step'
UNION ALL SELECT 'perf/throughput', round(alltok/(seconds*8),6)+0e0 FROM st, tt WHERE stage='step'""")(
    lambda spark, sf: nv(R.throughput_metrics(stages(spark, sf), with_lengths(spark, sf), 8)))

# fixed values: metric names given to the events, two per event type
EVENT_NAMES = {
    ("view", 0): "actor/loss", ("view", 1): "critic/score/mean",
    ("click", 0): "timing_s/step", ("click", 1): "timing_s/gen",
    ("error", 0): "global_seqlen/max", ("error", 1): "global_seqlen/min",
    ("purchase", 0): "perf/total_num_tokens", ("purchase", 1): "perf/time_per_step",
    ("signup", 0): "perf/throughput", ("signup", 1): "fully_async/count/current_param_version",
}
NAME_SQL = "CASE " + " ".join(f"WHEN event_type='{t}' AND event_id%2={i} THEN '{n}'" for (t, i), n in EVENT_NAMES.items()) + " END"
SM = f""", sm AS (SELECT event_id AS step, {NAME_SQL} AS name, value FROM events),
  sn AS (SELECT * FROM sm UNION ALL SELECT step, 'global_seqlen/minmax_diff', value FROM sm WHERE name='global_seqlen/max')
"""


def step_metrics(spark, sf):
    e = table(spark, sf, "events")
    name = F.expr(NAME_SQL)
    m = e.select(F.col("event_id").alias("step"), name.alias("name"), "value")
    diff = m.where("name = 'global_seqlen/max'").withColumn("name", F.lit("global_seqlen/minmax_diff"))
    return m.unionByName(diff)


C.add("reduce_metrics", SM + """
SELECT name, round(CASE WHEN name='perf/throughput' THEN sum(value) WHEN contains(name,'max') THEN max(value) WHEN contains(name,'min') THEN min(value) ELSE avg(value) END,6)+0e0 AS value
FROM sn GROUP BY name""")(lambda spark, sf: nv(R.reduce_metrics(step_metrics(spark, sf), {"perf/throughput": "sum"})))


@C.add("merge_accumulators", """
SELECT event_type AS name, CASE event_type WHEN 'view' THEN 'mean' WHEN 'click' THEN 'sum' WHEN 'error' THEN 'min' ELSE 'max' END AS kind,
  round(CASE event_type WHEN 'view' THEN avg(value) WHEN 'click' THEN sum(value) WHEN 'error' THEN min(value) ELSE max(value) END,6)+0e0 AS value
FROM events GROUP BY event_type""")
def _(spark, sf):
    kind = (F.when(F.col("event_type") == "view", "mean").when(F.col("event_type") == "click", "sum")
            .when(F.col("event_type") == "error", "min").otherwise("max"))
    parts = table(spark, sf, "events").groupBy(F.col("event_type").alias("name"), kind.alias("kind"), F.col("user_id").alias("worker")).agg(
        F.sum("value").alias("total"), F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return rounded(R.merge_accumulators(parts), "name", "kind", value="value")


AGG_CASE = """CASE WHEN name LIKE 'perf/time_per_step' OR name LIKE '%timing_s/%' THEN sum(value)
   WHEN name='fully_async/count/current_param_version' THEN arg_max(value, step)
   WHEN contains(name,'mean') THEN avg(value) WHEN contains(name,'max') THEN max(value) WHEN contains(name,'min') THEN min(value)
   WHEN contains(name,'total') THEN sum(value) ELSE avg(value) END"""
C.add("aggregate_step_metrics", SM + f""", ag AS (SELECT name, {AGG_CASE} AS v FROM sn GROUP BY name),
  g AS (SELECT max(v) FILTER (name='global_seqlen/max') AS gmax, max(v) FILTER (name='global_seqlen/min') AS gmin,
    max(v) FILTER (name='perf/total_num_tokens') AS tok, max(v) FILTER (name='perf/time_per_step') AS sec,
    max(v) FILTER (name='timing_s/gen') AS gen, max(v) FILTER (name='timing_s/step') AS stp FROM ag)
SELECT name, round(CASE name WHEN 'global_seqlen/minmax_diff' THEN gmax-gmin WHEN 'perf/throughput' THEN tok/(sec*16) ELSE v END,6)+0e0 AS value FROM ag, g
UNION ALL SELECT 'trainer/idle_ratio', round(gen/stp,6)+0e0 FROM g""")(
    lambda spark, sf: nv(R.aggregate_step_metrics(step_metrics(spark, sf), 16)))

C.add("sanitize_metric_names", """, n AS (SELECT DISTINCT 'val//'||lang||'@'||source||' [m]' AS name FROM documents)
SELECT name, regexp_replace(regexp_replace(replace(name,'@','_at_'),'/+','/','g'),'[^/\\w.\\- :]','_','g') AS clean FROM n""")(
    lambda spark, sf: R.sanitize_metric_names(table(spark, sf, "documents").select(
        F.concat(F.lit("val//"), "lang", F.lit("@"), "source", F.lit(" [m]")).alias("name")).distinct()))
C.add("name_collisions", """, n AS (SELECT DISTINCT lang||CASE doc_id%3 WHEN 0 THEN '@' WHEN 1 THEN '_at_' ELSE '?' END||source AS name FROM documents),
  c AS (SELECT name, regexp_replace(regexp_replace(replace(name,'@','_at_'),'/+','/','g'),'[^/\\w.\\- :]','_','g') AS clean FROM n)
SELECT clean, count(*) AS names FROM c GROUP BY clean HAVING count(*)>1""")(
    lambda spark, sf: R.name_collisions(table(spark, sf, "documents").select(F.concat(
        "lang", F.when(F.col("doc_id") % 3 == 0, "@").when(F.col("doc_id") % 3 == 1, "_at_").otherwise("?"), "source").alias("name"))))


@C.add("compare_runs", """, m AS (SELECT user_id AS run, dayofmonth(ts) AS step, event_type AS name, avg(value) AS value FROM events GROUP BY ALL)
SELECT o.run, CAST(o.step AS BIGINT) AS step, o.name, abs(g.value-o.value) <= CASE o.name WHEN 'view' THEN 10 ELSE 1 END + CASE o.name WHEN 'view' THEN 0.1 ELSE 0.3 END*abs(o.value) AS close
FROM m o JOIN m g ON g.run=0 AND g.step=o.step AND g.name=o.name WHERE o.run<>0 AND o.name IN ('view','click')""")
def _(spark, sf):
    m = table(spark, sf, "events").groupBy(
        F.col("user_id").alias("run"), F.dayofmonth("ts").cast("long").alias("step"), F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    return R.compare_runs(m.where("run = 0").drop("run"), m.where("run <> 0"), {"view": (10.0, 0.1), "click": (1.0, 0.3)}).select("run", "step", "name", "close")


def timed(spark, sf):
    return with_lengths(spark, sf).withColumn("processing_time", F.col("gen_time") + F.col("tool_time"))


C.add("latency_percentiles", RL + """, p AS (SELECT *, gen_time+tool_time AS pt FROM rl)
""" + long_sql([
    ("fully_async/processing_time/avg", "avg(pt)"), ("fully_async/processing_time/max", "max(pt)"), ("fully_async/processing_time/min", "min(pt)"),
    ("timing_s/agent_loop/tool_calls/max", "max(tool_time)"), ("timing_s/agent_loop/tool_calls/min", "min(tool_time)"),
    ("timing_s/agent_loop/tool_calls/mean", "avg(tool_time)"), ("fully_async/processing_time/tp50", "quantile_cont(pt,0.5)"),
    ("fully_async/processing_time/tp99", "quantile_cont(pt,0.99)"), ("fully_async/processing_time/tp95", "quantile_cont(pt,0.95)")], "p"))(
    lambda spark, sf: nv(R.latency_percentiles(timed(spark, sf))))


@C.add("latency_sketches", RL + """, s AS (SELECT traj_id%5 AS worker, gen_time+tool_time AS pt FROM rl)
SELECT worker, count(*) AS n, round(avg(pt),6)+0e0 AS avg, round(min(pt),6)+0e0 AS min, round(max(pt),6)+0e0 AS max, true AS within FROM s GROUP BY worker""")
def _(spark, sf):
    """Sketches of three parts, merged; each percentile's true rank is within the stated error."""
    d = timed(spark, sf).withColumn("worker", F.col("traj_id") % 5)
    parts = [R.latency_sketches(d.where(F.pmod(F.xxhash64("traj_id"), F.lit(3)) == k), ["worker"]) for k in (2, 0, 1)]
    p = R.sketch_percentiles(R.merge_latency_sketches(*parts, keys=["worker"]), ["worker"])
    err = R.sketch_rank_error(2048)
    x = F.col("processing_time")
    ranks = d.join(p.select("worker", "tp50", "tp95", "tp99"), "worker").groupBy("worker").agg(*[
        ((F.avg((x < F.col(c)).cast("double")) <= q + err) & (F.avg((x <= F.col(c)).cast("double")) >= q - err)).alias(c) for c, q in (("tp50", 0.5), ("tp95", 0.95), ("tp99", 0.99))])
    d = p.drop("tp50", "tp95", "tp99").join(ranks, "worker").withColumn("within", F.col("tp50") & F.col("tp95") & F.col("tp99"))
    return rounded(d, "worker", "n", "within", avg="avg", min="min", max="max")


C.add("slowest_sample", RL + ", s AS (SELECT * FROM rl ORDER BY gen_time+tool_time DESC, traj_id LIMIT 1)\n" + long_sql(
    three("agent_loop/generate_sequences", "gen_time", "true", ("min", "max", "mean"))
    + three("agent_loop/tool_calls", "tool_time", "true", ("min", "max", "mean")), "rl") + "\nUNION ALL " + long_sql([
    ("agent_loop/slowest/generate_sequences", "gen_time"), ("agent_loop/slowest/tool_calls", "tool_time"),
    ("agent_loop/slowest/prompt_length", "prompt_len"), ("agent_loop/slowest/response_length", "response_len")], "s"))(
    lambda spark, sf: nv(R.slowest_sample(with_lengths(spark, sf))))


@C.add("retry_summary", """, t AS (SELECT conv_id AS question_id, turn, CASE WHEN length(text)%5=0 THEN 1.0 ELSE 0.25 END AS reward, length(text) AS context_len FROM conversations)
SELECT question_id, max(turn)+1 AS total_turns, round(arg_max(reward, turn),6)+0e0 AS final_reward, min(turn) FILTER (reward>=1) AS first_solved_turn,
       CAST(max(context_len) AS BIGINT) AS max_context_len FROM t GROUP BY question_id""")
def _(spark, sf):
    t = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("question_id"), "turn", F.when(F.length("text") % 5 == 0, 1.0).otherwise(0.25).alias("reward"),
        F.length("text").cast("long").alias("context_len"))
    return rounded(R.retry_summary(t), "question_id", "total_turns", "first_solved_turn", "max_context_len", final_reward="final_reward")


FG = "self_distillation/feedback_generator/"
C.add("feedback_generation_metrics", """, f AS (SELECT CASE WHEN turn%5=4 THEN '  ' ELSE text END AS text, turn%3 AS attempts, length(text)%7<>0 AS success, length(text) AS tokens FROM conversations)
""" + long_sql([
    (FG + "generated_tokens", "sum(tokens)"), (FG + "tokens_per_second", "sum(tokens)/20e0"), (FG + "total_duration_s", "20e0+0*count(*)"),
    (FG + "requests_requested", "count(*)"), (FG + "api_requests_sent", "sum(greatest(attempts,1))"),
    (FG + "generated_feedback_count", "count(*) FILTER (length(trim(text))>0)"), (FG + "failed_feedback_count", "count(*) FILTER (NOT success)"),
    (FG + "retry_count", "greatest(sum(greatest(attempts,1))-count(*),0)"), (FG + "time_fraction_of_step", "0.25e0+0*count(*)"),
    (FG + "time_percent_of_step", "25e0+0*count(*)")], "f"))(
    lambda spark, sf: nv(R.feedback_generation_metrics(table(spark, sf, "conversations").select(
        F.when(F.col("turn") % 5 == 4, "  ").otherwise(F.col("text")).alias("text"), (F.col("turn") % 3).alias("attempts"),
        (F.length("text") % 7 != 0).alias("success"), F.length("text").alias("tokens")), 20.0, 80.0)))


# ---------------------------------------------------------------- validation
def mets(df):
    return rounded(df, "data_source", "var", "metric", value="value")


def samples(spark, sf):
    return V.melt_vars(rollouts(spark, sf), ["score", "acc"])


SA = """, sa AS (SELECT data_source, uid, 'score' AS var, score AS value FROM rollouts UNION ALL SELECT data_source, uid, 'acc', acc FROM rollouts),
  g AS (SELECT data_source, uid, var, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM sa GROUP BY ALL)
"""
MS = """(SELECT data_source, var, 'mean@'||n AS metric, avg(m) AS v FROM g GROUP BY ALL
  UNION ALL SELECT data_source, var, 'std@'||n, avg(s) FROM g WHERE n>1 GROUP BY ALL)"""
C.add("validation_metrics", SA + f"SELECT data_source, var, metric, round(v,6)+0e0 AS value FROM {MS}")(
    lambda spark, sf: mets(V.validation_metrics(samples(spark, sf))))
BW = """, x AS (SELECT *, row_number() OVER (PARTITION BY data_source, uid, var ORDER BY value) AS i, count(*) OVER (PARTITION BY data_source, uid, var) AS cnt FROM sa),
  ns AS (SELECT DISTINCT cnt, unnest(list_append([p FOR p IN [2,4,8,16,32,64,128] IF p<cnt], cnt)) AS n FROM x WHERE cnt>1),
  w AS (SELECT data_source, uid, var, n, value, pow(i/cnt,n)-pow((i-1)/cnt,n) AS b, pow((cnt-i+1)/cnt,n)-pow((cnt-i)/cnt,n) AS o FROM x JOIN ns USING (cnt)),
  e AS (SELECT data_source, uid, var, n, sum(b*value) AS bm, sum(b*value*value) AS b2, sum(o*value) AS om, sum(o*value*value) AS o2 FROM w GROUP BY ALL),
  u AS (SELECT data_source, var, 'best@'||n||'/mean' AS metric, bm AS v FROM e UNION ALL SELECT data_source, var, 'best@'||n||'/std', sqrt(greatest(b2-bm*bm,0)) FROM e
    UNION ALL SELECT data_source, var, 'worst@'||n||'/mean', om FROM e UNION ALL SELECT data_source, var, 'worst@'||n||'/std', sqrt(greatest(o2-om*om,0)) FROM e)
"""
C.add("best_worst_at_n", SA + BW + "SELECT data_source, var, metric, round(avg(v),6)+0e0 AS value FROM u GROUP BY ALL")(
    lambda spark, sf: mets(V.best_worst_at_n(samples(spark, sf))))
C.add("maj_full_vote", """, p AS (SELECT data_source, uid, pred, count(*) AS n, min(traj_id) AS f, arg_min(score, traj_id) AS v FROM rollouts GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY data_source, uid ORDER BY n DESC, f) AS rk, sum(n) OVER (PARTITION BY data_source, uid) AS cnt FROM p)
SELECT data_source, 'score' AS var, 'maj@'||CAST(cnt AS BIGINT)||'/vote' AS metric, round(avg(v),6)+0e0 AS value FROM r WHERE rk=1 GROUP BY ALL""")(
    lambda spark, sf: mets(V.maj_full_vote(rollouts(spark, sf), "score")))
def _spread(name, source, cols, x):
    """The number hash of the vote's draws, step by step."""
    wrap = "CAST((CAST(y AS UHUGEINT)*{}) % 18446744073709551616 AS UBIGINT)"
    return f"""{name}1 AS (SELECT {cols}, {x} AS x FROM {source}), {name}2 AS (SELECT {cols}, xor(x, x>>30) AS y FROM {name}1), {name}3 AS (SELECT {cols}, {wrap.format(13787848793156543929)} AS x FROM {name}2),
  {name}4 AS (SELECT {cols}, xor(x, x>>27) AS y FROM {name}3), {name}5 AS (SELECT {cols}, {wrap.format(10723151780598845931)} AS x FROM {name}4), {name} AS (SELECT {cols}, xor(x, x>>31) AS x FROM {name}5)"""


# the given tables have up to five preds: each gets its draws from a binomial of what the ones before left
PREDS = range(1, 6)
MAJ = """, mv AS (SELECT data_source, uid, pred, count(*) AS c, count(score) AS ks, sum(score) AS ss, sum(score*score) AS qs, count(acc) AS ka, sum(acc) AS sa, sum(acc*acc) AS qa FROM rollouts GROUP BY ALL),
  mo AS (SELECT *, row_number() OVER (PARTITION BY data_source, uid ORDER BY c DESC, pred) AS i FROM mv),
  mg AS (SELECT data_source, uid, list(c ORDER BY i) AS cs, CAST(sum(c) AS BIGINT) AS cnt FROM mo GROUP BY ALL HAVING sum(c)>1),
  mq AS (SELECT DISTINCT cs, unnest(list_append([p FOR p IN [2,4,8,16,32,64,128] IF p<cnt], cnt)) AS n FROM mg),
  mr AS (SELECT n, unnest(range(1000)) AS rep FROM (SELECT DISTINCT n FROM mq)),
  """ + _spread("mk", "mr", "n, rep", "CAST(42*281474976710656+n*1048576+rep AS UBIGINT)") + """,
  mi AS (SELECT n, rep, x AS key, unnest([1,2,3,4,5]) AS i FROM mk),
  """ + _spread("mh", "mi", "n, rep, i", "CAST((CAST(key AS UHUGEINT)+CAST(i AS UHUGEINT)*11400714819323198485) % 18446744073709551616 AS UBIGINT)") + """,
  mu AS (SELECT n, rep, i, (CAST(x>>11 AS DOUBLE)+0.5)/9007199254740992e0 AS u FROM mh),
  mab AS (SELECT DISTINCT cs[i] AS a, CAST(list_sum(cs[i:]) AS BIGINT) AS b FROM mg, (SELECT unnest([1,2,3,4,5]) AS i) WHERE i<len(cs)),
  mcd AS (SELECT a, b, r, list(upto ORDER BY k) AS l FROM (SELECT *, sum(exp(lgamma(r+1)-lgamma(k+1)-lgamma(r-k+1)+k*ln(a/b)+(r-k)*ln(1-a/b))) OVER (PARTITION BY a, b, r ORDER BY k) AS upto
    FROM (SELECT *, unnest(range(r+1)) AS k FROM (SELECT *, unnest(range((SELECT max(n) FROM mq)+1)) AS r FROM mab))) GROUP BY ALL),
  mc0 AS (SELECT cs, mq.n, rep, mq.n AS r FROM mq JOIN mr USING (n)),
  """ + ",\n  ".join(f"""mc{i} AS (SELECT q.* EXCLUDE (r), q.r-q.c{i} AS r FROM (SELECT p.*, CASE WHEN len(cs)<{i} THEN 0 WHEN len(cs)={i} THEN p.r ELSE len(list_filter(l, lambda x: x<=u)) END AS c{i}
    FROM mc{i - 1} p LEFT JOIN mcd d ON d.a=cs[{i}] AND d.b=CAST(list_sum(cs[{i}:]) AS BIGINT) AND d.r=p.r JOIN mu ON mu.n=p.n AND mu.rep=p.rep AND mu.i={i}) q)""" for i in PREDS) + """,
  mw AS (SELECT cs, n, unnest([1,2,3,4,5]) AS i, unnest([""" + ", ".join(f"avg(CASE WHEN c{i}=top THEN 1e0/ties ELSE 0e0 END)" for i in PREDS) + """]) AS w
    FROM (SELECT *, """ + "+".join(f"CAST(c{i}=top AS INTEGER)" for i in PREDS) + """ AS ties FROM (SELECT *, greatest(c1,c2,c3,c4,c5) AS top FROM mc5)) GROUP BY cs, n),
  me AS (SELECT data_source, uid, n, sum(w*ss/c)/sum(w*ks/c) AS vm, sum(w*qs/c)/sum(w*ks/c) AS vq, sum(w*sa/c)/sum(w*ka/c) AS am, sum(w*qa/c)/sum(w*ka/c) AS aq
    FROM mg JOIN mw USING (cs) JOIN mo USING (data_source, uid, i) GROUP BY ALL),
  mj AS (SELECT data_source, 'score' AS var, 'maj@'||n||'/mean' AS metric, avg(vm) AS v FROM me GROUP BY ALL
    UNION ALL SELECT data_source, 'score', 'maj@'||n||'/std', avg(sqrt(greatest(vq-vm*vm,0))) FROM me GROUP BY ALL
    UNION ALL SELECT data_source, 'acc', 'maj@'||n||'/mean', avg(am) FROM me GROUP BY ALL
    UNION ALL SELECT data_source, 'acc', 'maj@'||n||'/std', avg(sqrt(greatest(aq-am*am,0))) FROM me GROUP BY ALL)
"""
# a deviation is the root of a difference, so it is known to fewer places than a mean
PLACES = "CASE WHEN metric LIKE '%std%' THEN round(v,6) ELSE round(v,10) END"


def places(df):
    return df.select("data_source", "var", "metric", (F.when(F.col("metric").contains("std"), F.round("value", 6)).otherwise(F.round("value", 10)) + 0.0).alias("value"))


C.add("maj_at_n", MAJ + f"SELECT data_source, var, metric, {PLACES}+0e0 AS value FROM mj")(
    lambda spark, sf: places(V.maj_at_n(rollouts(spark, sf), ["score", "acc"])))
REP = """, al AS (SELECT data_source, var, metric, v FROM {ms} UNION ALL SELECT data_source, var, metric, avg(v) FROM u GROUP BY ALL),
  nn AS (SELECT *, CAST(regexp_extract(metric,'@(\\d+)',1) AS BIGINT) AS n, max(CAST(regexp_extract(metric,'@(\\d+)',1) AS BIGINT)) OVER (PARTITION BY data_source, var) AS top FROM al)
SELECT CASE WHEN var='acc' AND regexp_matches(metric,'^(mean|maj|best)') AND n=top THEN 'val-core' ELSE 'val-aux' END||'/'||data_source||'/'||var||'/'||metric AS name,
       round(v,6)+0e0 AS value FROM nn"""


@C.add("validation_report", SA + BW + REP.format(ms=MS))
def _(spark, sf):
    s = samples(spark, sf)
    return nv(V.validation_report(V.mean_std_at_n(s).unionByName(V.best_worst_at_n(s))))


@C.add("merge_validation", SA.replace("SELECT data_source, uid, 'acc', acc FROM rollouts", "SELECT data_source, uid, 'acc', acc FROM rollouts WHERE traj_id%2=0")
       + BW + REP.format(ms=MS))
def _(spark, sf):
    r = rollouts(spark, sf).select("data_source", "uid", "traj_id", "score", "acc")
    return nv(V.merge_validation(r.where("traj_id % 2 = 0"), r.where("traj_id % 2 <> 0").drop("acc"), ["score", "acc"]))


C.add("validation_extras", RL + long_sql([
    ("val-aux/num_turns/min", "min(num_turns)"), ("val-aux/num_turns/max", "max(num_turns)"), ("val-aux/num_turns/mean", "avg(num_turns)"),
    ("val-aux/self_distillation/teacher_acc_mean", "avg(acc)"), ("val-aux/generation/num_generated_tokens_mean", "avg(response_len)")], "rl"))(
    lambda spark, sf: nv(V.validation_extras(with_lengths(spark, sf).withColumns(
        {"teacher_acc": F.col("acc"), "num_generated_tokens": F.col("response_len")}))))


@C.add("eval_by_source", """, s AS (SELECT lang, doc_id, avg(CASE WHEN length(l)%2=0 THEN 1.0 ELSE 0.0 END) AS s
   FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY ALL)
SELECT 'test_score/'||lang AS name, round(avg(s),6)+0e0 AS value FROM s GROUP BY lang""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("data_source"), F.col("doc_id").alias("uid"), F.split("text", "\n").alias("responses"))
    e = V.explode_responses(d).withColumn("score", F.when(F.length("response") % 2 == 0, 1.0).otherwise(0.0))
    return nv(V.eval_by_source(e))


@C.add("incremental_validation", SA + f"SELECT data_source, var, metric, round(v,6)+0e0 AS value FROM {MS}")
def _(spark, sf):
    s = samples(spark, sf)
    late = F.xxhash64("uid", "value") % 3 == 0
    parts = V.merge_partials(V.validation_partials(s.where(~late)), V.validation_partials(s.where(late)))
    return mets(V.partials_to_metrics(parts))


@C.add("incremental_validation_counts", SA + BW + MAJ + f""", al AS (SELECT * FROM {MS} UNION ALL SELECT data_source, var, metric, avg(v) FROM u GROUP BY ALL UNION ALL SELECT * FROM mj)
SELECT data_source, var, metric, {PLACES}+0e0 AS value FROM al""")
def _(spark, sf):
    """Best, worst and majority of late results too: whole histograms merge, in any order of the parts."""
    r = rollouts(spark, sf).select("data_source", "uid", "traj_id", "pred", "score", "acc")
    late = F.xxhash64("traj_id") % 3
    parts = [r.where(late == 2), r.where(late == 0), r.where((late != 0) & (late != 2))]
    values = V.merge_value_counts(*[V.value_counts(V.melt_vars(p, ["score", "acc"])) for p in parts])
    votes = V.merge_vote_counts(*[V.vote_counts(p, ["score", "acc"]) for p in parts])
    return places(V.counts_to_metrics(values, votes))


# ---------------------------------------------------------------- demonstrations
C.add("successful_by_group", """SELECT uid, traj_id, row_number() OVER (PARTITION BY uid ORDER BY traj_id) AS success_no FROM rollouts WHERE score>=1""")(
    lambda spark, sf: D.successful_by_group(rollouts(spark, sf)))


def texts(spark, sf):
    """Rollouts with prompt, response, feedback and reference text made from their columns."""
    think = F.when(F.col("traj_id") % 2 == 0, F.concat(F.lit("<think>a\nb"), F.col("pred"), F.lit("</think>\n "))).otherwise("")
    return rollouts(spark, sf).withColumns({
        "prompt": F.concat(F.lit("Question "), F.col("uid").cast("string")),
        "response": F.concat(think, F.lit("answer "), F.col("traj_id").cast("string")),
        "feedback": F.when(F.col("score") < 0.5, F.concat(F.lit("wrong "), "pred")).when(F.col("score") < 1, " \n"),
        "reference": F.when(F.col("traj_id") % 3 == 0, F.concat(F.lit(" ref "), "pred")),
        "ground_truth": F.when(F.col("traj_id") % 5 != 0, F.col("data_source")),
    })


TX = """, tx AS (SELECT *, 'Question '||uid AS prompt,
     CASE WHEN traj_id%2=0 THEN '<think>a'||chr(10)||'b'||pred||'</think>'||chr(10)||' ' ELSE '' END||'answer '||traj_id AS response,
     CASE WHEN score<0.5 THEN 'wrong '||pred WHEN score<1 THEN ' '||chr(10) END AS feedback,
     CASE WHEN traj_id%3=0 THEN ' ref '||pred END AS reference, CASE WHEN traj_id%5<>0 THEN data_source END AS ground_truth FROM rollouts),
  dm AS (SELECT a.*, (SELECT min(b.traj_id) FROM rollouts b WHERE b.uid=a.uid AND b.score>=1) AS demo_any,
     (SELECT min(b.traj_id) FROM rollouts b WHERE b.uid=a.uid AND b.score>=1 AND b.traj_id<>a.traj_id) AS demo_other FROM tx a),
  ds AS (SELECT dm.*, 'answer '||demo_other AS solution, CASE WHEN length(trim(replace(feedback,chr(10),'')))>0 THEN feedback END AS feedback_text FROM dm)
"""
C.add("pick_demonstration", TX + "SELECT traj_id, demo_any AS demo_traj_id FROM dm")(
    lambda spark, sf: D.pick_demonstration(rollouts(spark, sf)).select("traj_id", "demo_traj_id"))
C.add("pick_demonstration_other", TX + "SELECT traj_id, demo_other AS demo_traj_id, solution FROM ds")(
    lambda spark, sf: D.pick_demonstration(texts(spark, sf), exclude_self=True, remove_thinking=True, response="response").select(
        "traj_id", "demo_traj_id", "solution"))
C.add("collect_feedback", TX + "SELECT traj_id, feedback_text FROM ds")(
    lambda spark, sf: D.collect_feedback(texts(spark, sf)).select("traj_id", "feedback_text"))
C.add("reference_feedback", TX + """SELECT traj_id, CASE WHEN length(trim(coalesce(reference,ground_truth,'')))>0
   THEN chr(10)||chr(10)||'Here is a correct answer to this problem:'||chr(10)||trim(coalesce(reference,ground_truth))||chr(10)||chr(10) ELSE '' END AS generated_feedback FROM tx""")(
    lambda spark, sf: D.reference_feedback(texts(spark, sf)).select("traj_id", "generated_feedback"))
C.add("collect_feedback_generated", TX + """SELECT traj_id, CASE WHEN demo_other IS NULL AND length(trim(coalesce(reference,ground_truth,'')))>0
   THEN 'Here is a correct answer to this problem:'||chr(10)||trim(coalesce(reference,ground_truth)) END AS feedback_text FROM dm""")(
    lambda spark, sf: D.collect_feedback(
        D.reference_feedback(D.pick_demonstration(texts(spark, sf), exclude_self=True)).withColumn(
            "generated_feedback", F.regexp_replace("generated_feedback", "^\n+|\n+$", "")),
        generated="generated_feedback", only_where=F.col("demo_traj_id").isNull()).select("traj_id", "feedback_text"))


def reprompted(spark, sf):
    d = D.pick_demonstration(texts(spark, sf), exclude_self=True, remove_thinking=True, response="response")
    return D.collect_feedback(d).withColumn("available", F.col("solution"))


C.add("reprompt_table", TX + """SELECT traj_id, demo_other IS NOT NULL OR feedback_text IS NOT NULL AS reprompted, 'system' AS role0,
  prompt || CASE WHEN demo_other IS NOT NULL OR feedback_text IS NOT NULL THEN
    CASE WHEN solution IS NOT NULL THEN chr(10)||'Correct solution:'||chr(10)||chr(10)||solution ELSE '' END ||
    CASE WHEN feedback_text IS NOT NULL AND solution IS NULL THEN chr(10)||'The following is feedback from your unsuccessful earlier attempt:'||chr(10)||chr(10)||feedback_text ELSE '' END ||
    chr(10)||chr(10)||'Correctly solve the original question.' ELSE '' END AS content FROM ds""")(
    lambda spark, sf: D.reprompt_table(reprompted(spark, sf), feedback_only_without_solution=True, system="data_source").select(
        "traj_id", "reprompted", F.col("reprompt")[0]["role"].alias("role0"), F.col("reprompt")[1]["content"].alias("content")))
C.add("reprompt_metrics", TX + """, gs AS (SELECT uid, max(score) AS s FROM ds GROUP BY uid)
SELECT round(avg(CASE WHEN solution IS NOT NULL THEN 1 ELSE 0 END),6)+0e0 AS success_sample_fraction, round(avg(CASE WHEN solution IS NOT NULL THEN 1 ELSE 0 END),6)+0e0 AS solution_used_fraction,
  round(avg(CASE WHEN feedback_text IS NOT NULL THEN 1 ELSE 0 END),6)+0e0 AS feedback_available_fraction, round(avg(CASE WHEN feedback_text IS NOT NULL THEN 1 ELSE 0 END),6)+0e0 AS feedback_used_fraction,
  round(avg(CASE WHEN solution IS NOT NULL OR feedback_text IS NOT NULL THEN 1 ELSE 0 END),6)+0e0 AS reprompt_sample_fraction,
  (SELECT round(avg(CASE WHEN s>=1 THEN 1 ELSE 0 END),6)+0e0 FROM gs) AS success_group_fraction FROM ds""")(
    lambda spark, sf: (lambda m: m.select(*[r6(c).alias(c) for c in m.columns]))(D.reprompt_metrics(reprompted(spark, sf))))
C.add("shared_prefix_groups", """, l AS (SELECT traj_id, data_source, CASE WHEN lag(data_source) OVER (ORDER BY traj_id)=data_source THEN 0 ELSE 1 END AS s FROM rollouts),
  g AS (SELECT *, CAST(sum(s) OVER (ORDER BY traj_id) AS BIGINT) AS group_no FROM l)
SELECT group_no, data_source, min(traj_id) AS first_row, count(*) AS group_size FROM g GROUP BY group_no, data_source""")(
    lambda spark, sf: D.shared_prefix_groups(rollouts(spark, sf), label="data_source"))
