"""Checks of masked statistics and advantage estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import r6, rounded
from ..operators import advantages as A
from ..plans.views import line_count, rollouts, table, tokens
from .oracle import CATALOG as C


def roll_out(df):
    return rounded(df, "traj_id", advantage="advantage")


def tok_out(df):
    return rounded(df, "traj_id", "t", advantage="advantage", ret="return")


def roll(name, fn, sql):
    C.add(name, sql)(lambda spark, sf: roll_out(fn(rollouts(spark, sf))))


C.add("masked_mean", """
SELECT traj_id, round(coalesce(sum(CASE WHEN mask=1 THEN value END),0),6)+0e0 AS masked_sum,
       round(coalesce(sum(CASE WHEN mask=1 THEN value END),0)/(sum(mask)+1e-8),6)+0e0 AS masked_mean,
       CAST(sum(mask) AS BIGINT) AS mask_count FROM tokens GROUP BY traj_id""")(
    lambda spark, sf: A.masked_stats(tokens(spark, sf), "value", keys=["traj_id"]).select(
        "traj_id", r6("masked_sum").alias("masked_sum"), r6("masked_mean").alias("masked_mean"), "mask_count"))

C.add("masked_sum", "SELECT round(sum(value*mask),6)+0e0 AS masked_sum, CAST(sum(mask) AS BIGINT) AS mask_count FROM tokens")(
    lambda spark, sf: A.masked_stats(tokens(spark, sf), "value").select(r6("masked_sum").alias("masked_sum"), "mask_count"))
C.add("register_advantage", """
SELECT traj_id, round(score - CASE WHEN count(*) OVER g = 1 THEN 0 ELSE avg(score) OVER g END, 6)+0e0 AS advantage
FROM rollouts WINDOW g AS (PARTITION BY uid)""")(
    lambda spark, sf: roll_out(A.get_advantage("grpo")(rollouts(spark, sf), norm_by_std=False)))

C.add("masked_var", """
SELECT sum(mask)+0e0 AS n, round(sum(value*mask)/(sum(mask)+1e-8),6)+0e0 AS mean,
       round(var_samp(value) FILTER (mask=1),6)+0e0 AS var FROM tokens""")(
    lambda spark, sf: A.masked_var(tokens(spark, sf), "value").select("n", r6("mean").alias("mean"), r6("var").alias("var")))

C.add("masked_whiten", """
, m AS (SELECT avg(value) AS mu, var_samp(value) AS v FROM tokens WHERE mask=1)
SELECT traj_id, t, round((value-mu)/sqrt(v+1e-8),6)+0e0 AS whitened FROM tokens, m""")(
    lambda spark, sf: A.whiten(tokens(spark, sf), "value", "w").select("traj_id", "t", r6("w").alias("whitened")))

C.add("global_stats", """
SELECT round(avg(value),6)+0e0 AS mean, round(max(value),6)+0e0 AS max, round(min(value),6)+0e0 AS min,
       round(stddev_samp(value),6)+0e0 AS std FROM tokens""")(
    lambda spark, sf: A.global_stats(tokens(spark, sf), "value").select(*[r6(c).alias(c) for c in ("mean", "max", "min", "std")]))

C.add("global_masked_mean", """
SELECT round(sum(value*mask)/(sum(mask)+1e-8),6)+0e0 AS masked_mean FROM tokens""")(
    lambda spark, sf: A.global_masked_mean(tokens(spark, sf), "value").select(r6("masked_mean").alias("masked_mean")))

C.add("group_mean_std", """
SELECT uid, round(CASE WHEN count(*)>1 THEN avg(score) ELSE 0 END,6)+0e0 AS mean,
       round(CASE WHEN count(*)>1 THEN sqrt(greatest(var_samp(score),1e-6)) ELSE 1 END,6)+0e0 AS std, count(*) AS n
FROM rollouts GROUP BY uid""")(
    lambda spark, sf: A.group_mean_std(rollouts(spark, sf)).select("uid", r6("mean").alias("mean"), r6("std").alias("std"), "n"))

roll("adv_grpo", A.adv_grpo, """
SELECT traj_id, round(CASE WHEN count(*) OVER g = 1 THEN score/(1+1e-6)
       ELSE (score-avg(score) OVER g)/(stddev_samp(score) OVER g + 1e-6) END, 6)+0e0 AS advantage
FROM rollouts WINDOW g AS (PARTITION BY uid)""")
roll("adv_grpo_mean_only", lambda r: A.adv_grpo(r, norm_by_std=False), """
SELECT traj_id, round(score - CASE WHEN count(*) OVER g = 1 THEN 0 ELSE avg(score) OVER g END, 6)+0e0 AS advantage
FROM rollouts WINDOW g AS (PARTITION BY uid)""")
roll("adv_grpo_vectorized", A.adv_grpo_vectorized, """
SELECT traj_id, round(CASE WHEN count(*) OVER g = 1 THEN score/(1+1e-6)
       ELSE (score-avg(score) OVER g)/(sqrt(greatest(var_samp(score) OVER g, 1e-6)) + 1e-6) END, 6)+0e0 AS advantage
FROM rollouts WINDOW g AS (PARTITION BY uid)""")
roll("adv_grpo_passk", lambda r: A.adv_grpo_passk(r, small_groups="zero"), """
, k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, traj_id) AS rk,
        lead(score) OVER (PARTITION BY uid ORDER BY score DESC, traj_id) AS nxt,
        stddev_samp(score) OVER (PARTITION BY uid) AS sd FROM rollouts)
SELECT traj_id, round(CASE WHEN rk=1 AND nxt IS NOT NULL THEN (score-nxt)/(sd+1e-6) ELSE 0 END,6)+0e0 AS advantage FROM k""")
roll("adv_rloo", A.adv_rloo, """
SELECT traj_id, round(CASE WHEN count(*) OVER g = 1 THEN score
       ELSE score*count(*) OVER g/(count(*) OVER g - 1) - avg(score) OVER g * count(*) OVER g/(count(*) OVER g - 1) END,6)+0e0 AS advantage
FROM rollouts WINDOW g AS (PARTITION BY uid)""")
roll("adv_rloo_vectorized", A.adv_rloo_vectorized, """
SELECT traj_id, round(CASE WHEN count(*) OVER g = 1 THEN 0
       ELSE (count(*) OVER g * score - sum(score) OVER g)/(count(*) OVER g - 1) END,6)+0e0 AS advantage
FROM rollouts WINDOW g AS (PARTITION BY uid)""")
roll("adv_opo", A.adv_opo, """
SELECT traj_id, round(score - CASE WHEN count(*) OVER g = 1 THEN 0
       ELSE sum(response_len*score) OVER g / sum(response_len) OVER g END,6)+0e0 AS advantage
FROM rollouts WINDOW g AS (PARTITION BY uid)""")
roll("adv_gpg", A.adv_gpg, """
, a AS (SELECT count(*)/greatest(count(*) FILTER (score<>0),1) AS alpha FROM rollouts)
SELECT traj_id, round(alpha*(score - CASE WHEN count(*) OVER g = 1 THEN 0 ELSE avg(score) OVER g END),6)+0e0 AS advantage
FROM rollouts, a WINDOW g AS (PARTITION BY uid)""")


@C.add("outcome_scores", """
SELECT uid, traj_id, round(sum(token_reward),6)+0e0 AS score, CAST(sum(mask) AS BIGINT) AS response_len
FROM tokens GROUP BY uid, traj_id""")
def _(spark, sf):
    return A.outcome_scores(tokens(spark, sf)).select("uid", "traj_id", r6("score").alias("score"), "response_len")


@C.add("adv_grpo_tokens", """
, g AS (SELECT traj_id, CASE WHEN count(*) OVER g = 1 THEN score/(1+1e-6)
       ELSE (score-avg(score) OVER g)/(stddev_samp(score) OVER g + 1e-6) END AS a FROM rollouts WINDOW g AS (PARTITION BY uid))
SELECT traj_id, t, round(a*mask,6)+0e0 AS advantage, round(a*mask,6)+0e0 AS ret FROM tokens JOIN g USING (traj_id)""")
def _(spark, sf):
    return tok_out(A.spread_to_tokens(tokens(spark, sf), A.adv_grpo(rollouts(spark, sf))))


@C.add("adv_reinforce_pp_baseline", """
, c AS (SELECT traj_id, score - CASE WHEN count(*) OVER g = 1 THEN 0 ELSE avg(score) OVER g END AS x
        FROM rollouts WINDOW g AS (PARTITION BY uid)),
  s AS (SELECT tokens.traj_id, t, mask, x FROM tokens JOIN c USING (traj_id)),
  m AS (SELECT avg(x) AS mu, var_samp(x) AS v FROM s WHERE mask=1)
SELECT traj_id, t, round((x-mu)/sqrt(v+1e-8)*mask,6)+0e0 AS advantage,
       round((x-mu)/sqrt(v+1e-8)*mask,6)+0e0 AS ret FROM s, m""")
def _(spark, sf):
    return tok_out(A.adv_reinforce_pp_baseline(tokens(spark, sf), rollouts(spark, sf)))


def rfpp_sql(gamma):
    return f"""
, z AS (SELECT *, sum(1-mask) OVER (PARTITION BY traj_id ORDER BY t) AS run FROM tokens),
  r AS (SELECT a.traj_id, a.t, any_value(a.mask) AS mask, sum(b.token_reward*power({gamma}, b.t-a.t)) AS ret
        FROM z a JOIN z b ON a.traj_id=b.traj_id AND a.run=b.run AND b.t>=a.t GROUP BY a.traj_id, a.t),
  m AS (SELECT avg(ret) AS mu, var_samp(ret) AS v FROM r WHERE mask=1)
SELECT traj_id, t, round((ret-mu)/sqrt(v+1e-8)*mask,6)+0e0 AS advantage, round(ret,6)+0e0 AS ret FROM r, m"""


C.add("adv_reinforce_pp", rfpp_sql("1e0"))(lambda spark, sf: tok_out(A.adv_reinforce_pp(tokens(spark, sf))))
C.add("adv_reinforce_pp_discounted", rfpp_sql("0.9e0"))(
    lambda spark, sf: tok_out(A.adv_reinforce_pp(tokens(spark, sf), gamma=0.9)))


def gae_sql(gamma, lam):
    # a masked row stands where the next valid one does: p counts the valid rows from the end
    return f"""
, v AS (SELECT *, row_number() OVER w AS p, token_reward + {gamma}*coalesce(lead(value) OVER w, 0) - value AS delta
        FROM tokens WHERE mask=1 WINDOW w AS (PARTITION BY traj_id ORDER BY t)),
  g AS (SELECT a.traj_id, a.p, sum(b.delta*power({gamma}*{lam}, b.p-a.p)) AS adv
        FROM v a JOIN v b ON a.traj_id=b.traj_id AND b.p>=a.p GROUP BY a.traj_id, a.p),
  m AS (SELECT avg(adv) AS mu, var_samp(adv) AS s2 FROM g),
  n AS (SELECT t.traj_id, t.t, t.value, min(v.p) AS p FROM tokens t LEFT JOIN v ON v.traj_id=t.traj_id AND v.t>=t.t
        GROUP BY t.traj_id, t.t, t.value)
SELECT n.traj_id, t, round((coalesce(adv,0)-mu)/sqrt(s2+1e-8),6)+0e0 AS advantage, round(coalesce(adv,0)+value,6)+0e0 AS ret
FROM m, n LEFT JOIN g ON g.traj_id=n.traj_id AND g.p=n.p"""


# factors with many digits keep results off decimal ties at the sixth place
C.add("adv_gae", gae_sql("0.987654321e0", "0.957e0"))(
    lambda spark, sf: tok_out(A.adv_gae(tokens(spark, sf), 0.987654321, 0.957)))
C.add("adv_gae_undiscounted", gae_sql("1e0", "1e0"))(lambda spark, sf: tok_out(A.adv_gae(tokens(spark, sf))))


@C.add("adv_remax", """
, b AS (SELECT uid, arg_min(score, traj_id) AS baseline FROM rollouts GROUP BY uid)
SELECT traj_id, t, round(sum(token_reward*mask) OVER w - baseline*mask,6)+0e0 AS advantage,
       round(sum(token_reward*mask) OVER w,6)+0e0 AS ret
FROM tokens JOIN b USING (uid) WINDOW w AS (PARTITION BY traj_id ORDER BY t DESC)""")
def _(spark, sf):
    base = rollouts(spark, sf).groupBy("uid").agg(F.min_by("score", "traj_id").alias("baseline"))
    return tok_out(A.adv_remax(tokens(spark, sf), base))


def otb_sql(pos, tail, keep_empty, weight="1"):
    empty = "" if keep_empty else "WHERE len > 0"
    zero = "WHEN len=longest AND longest>second AND e.pos>second THEN 0" if tail else ""
    return f"""
, d AS (SELECT *, sum(token_reward*mask) OVER (PARTITION BY traj_id ORDER BY t DESC) AS g,
        sum((1-2*exp(old_logp)+sum_pi_sq)*mask*{weight}) OVER (PARTITION BY traj_id ORDER BY t) AS cw,
        sum(mask) OVER (PARTITION BY traj_id ORDER BY t) AS vpos FROM tokens),
  e AS (SELECT *, {pos} AS pos FROM d),
  l AS (SELECT uid, traj_id, sum(mask) AS len FROM tokens GROUP BY uid, traj_id),
  gl AS (SELECT uid, list_sort(list(len),'DESC') AS ls, count(*) AS n FROM l {empty} GROUP BY uid),
  gs AS (SELECT uid, n, ls[1] AS longest, ls[2] AS second FROM gl),
  b AS (SELECT uid, pos, sum(g*cw)/(sum(cw)+1e-8) AS b FROM e WHERE mask=1 GROUP BY uid, pos)
SELECT e.traj_id, e.t, round(g - CASE WHEN n=1 THEN 0 {zero} ELSE b END,6)+0e0 AS advantage, round(g,6)+0e0 AS ret
FROM e JOIN b ON e.uid=b.uid AND e.pos=b.pos JOIN gs ON e.uid=gs.uid JOIN l ON l.traj_id=e.traj_id AND l.uid=e.uid WHERE mask=1
UNION ALL SELECT traj_id, t, 0e0, round(g,6)+0e0 FROM e WHERE mask<>1"""


def otb_out(spark, sf, fn, **kw):
    n = line_count(spark, sf)
    t = tokens(spark, sf, n).withColumn("w", F.least(F.exp(F.col("old_logp") - F.col("rollout_logp")), F.lit(2.0)))
    return tok_out(fn(t, rows=n, **kw))


C.add("adv_optimal_token_baseline", otb_sql("t", False, True))(
    lambda spark, sf: otb_out(spark, sf, A.adv_optimal_token_baseline))
C.add("adv_optimal_token_baseline_weighted", otb_sql("t", True, True, "pow(least(exp(old_logp-rollout_logp),2),2)"))(
    lambda spark, sf: otb_out(spark, sf, A.adv_optimal_token_baseline, is_weight="w", zero_tail=True))
C.add("adv_optimal_token_baseline_multiturn", otb_sql("vpos", True, False))(
    lambda spark, sf: otb_out(spark, sf, A.adv_optimal_token_baseline_multiturn))

KL_SQL = {
    "k1": "old_logp-ref_logp",
    "abs": "abs(old_logp-ref_logp)",
    "k2": "0.5*(old_logp-ref_logp)*(old_logp-ref_logp)",
    "k3": "greatest(least(exp(greatest(least(ref_logp-old_logp,20),-20))-greatest(least(ref_logp-old_logp,20),-20)-1,10),-10)",
}
for _k, _e in KL_SQL.items():
    C.add(f"kl_in_reward_{_k}", f"""
SELECT traj_id, t, round(CASE WHEN mask=1 THEN {_e} ELSE 0 END,6)+0e0 AS kld,
       round(token_reward-0.05*CASE WHEN mask=1 THEN {_e} ELSE 0 END,6)+0e0 AS token_reward FROM tokens""")(
        lambda spark, sf, k=_k: A.kl_in_reward(tokens(spark, sf), k, 0.05).select(
            "traj_id", "t", r6("kld").alias("kld"), r6("token_reward").alias("token_reward")))

C.add("current_kl", f"""
, k AS (SELECT traj_id, sum(CASE WHEN mask=1 THEN {KL_SQL['k3']} ELSE 0 END)/(sum(mask)+1e-8) AS kl FROM tokens GROUP BY traj_id)
SELECT round(avg(kl),6)+0e0 AS current_kl FROM k""")(
    lambda spark, sf: A.current_kl(tokens(spark, sf), "k3").select(r6("current_kl").alias("current_kl")))


@C.add("adaptive_kl_series", """
, s AS (SELECT CAST(dayofmonth(ts) AS BIGINT) AS step, avg(value)/1000 AS kl, count(*) AS n FROM events GROUP BY 1),
  m AS (SELECT step, 1+greatest(least(kl/0.1-1,0.2),-0.2)*n/10000 AS f FROM s)
SELECT step, round(0.2*exp(coalesce(sum(ln(f)) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)),6)+0e0 AS coef_used,
       round(0.2*exp(sum(ln(f)) OVER (ORDER BY step)),6)+0e0 AS coef_after FROM m""")
def _(spark, sf):
    steps = table(spark, sf, "events").groupBy(F.dayofmonth("ts").cast("long").alias("step")).agg(
        (F.avg("value") / 1000).alias("kl"), F.count(F.lit(1)).alias("n"))
    return A.adaptive_kl_series(steps, 0.2, 0.1, 10000).select(
        "step", r6("coef_used").alias("coef_used"), r6("coef_after").alias("coef_after"))
