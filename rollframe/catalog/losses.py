"""Checks of loss statistics, importance weights, rejection and diagnostics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.exprs import r6, rounded
from ..operators import advantages as A
from ..operators import losses as L
from ..operators import offpolicy as O
from ..plans.views import rollouts, tokens
from .oracle import CATALOG as C


def loss_tokens(spark, sf):
    """Tokens with a current policy (the reference one) and the group advantage."""
    t = tokens(spark, sf).withColumn("logp", F.col("ref_logp"))
    return A.spread_to_tokens(t, A.adv_grpo(rollouts(spark, sf), norm_by_std=False))


LT = """, ga AS (SELECT traj_id, score - CASE WHEN count(*) OVER g = 1 THEN 0 ELSE avg(score) OVER g END AS a
        FROM rollouts WINDOW g AS (PARTITION BY uid)),
  lt AS (SELECT tokens.*, ref_logp AS logp, a*mask AS adv,
         greatest(least(ref_logp-old_logp,20),-20) AS d FROM tokens JOIN ga USING (traj_id)),
  lr AS (SELECT *, exp(d) AS r FROM lt)
"""
MODE_SQL = {
    "token-mean": "SELECT round(sum({x}*mask)/sum(mask),6)+0e0 AS loss FROM {f}",
    "seq-mean-token-sum": "SELECT round(sum(l)/count(*) FILTER (n>0),6)+0e0 AS loss FROM (SELECT sum({x}*mask) AS l, sum(mask) AS n FROM {f} GROUP BY traj_id)",
    "seq-mean-token-mean": "SELECT round(avg(l/n) FILTER (n>0),6)+0e0 AS loss FROM (SELECT sum({x}*mask) AS l, sum(mask) AS n FROM {f} GROUP BY traj_id)",
    "seq-mean-token-sum-norm": "SELECT round(sum(l)/max(w),6)+0e0 AS loss FROM (SELECT sum({x}*mask) AS l, max(t) AS w FROM {f} GROUP BY traj_id)",
}


def mm(x):
    return f"round(sum(CASE WHEN mask=1 THEN {x} ELSE 0 END)/(sum(mask)+1e-8),6)+0e0"


def all6(df):
    return df.select(*[r6(f"`{c}`").alias(c) for c in df.columns])


for _mode, _q in MODE_SQL.items():
    C.add("agg_loss_" + _mode.replace("-", "_"), _q.format(x="value", f="tokens"))(
        lambda spark, sf, m=_mode: all6(L.agg_loss(tokens(spark, sf), "value", m)))
C.add("entropy_agg", MODE_SQL["token-mean"].format(x="sum_pi_sq", f="tokens"))(
    lambda spark, sf: all6(L.entropy_agg(tokens(spark, sf), "sum_pi_sq")))

CLIP = """, pl AS (SELECT *, -adv*r AS l1, -adv*greatest(least(r,1.2),0.8) AS l2, -adv*3 AS l3 FROM lr),
  pc AS (SELECT *, greatest(l1,l2) AS up FROM pl)
"""
C.add("ppo_clip_stats", LT + CLIP + f"""
SELECT {mm("CASE WHEN adv<0 THEN least(l3,up) ELSE up END")} AS loss, {mm("CASE WHEN l2>l1 THEN 1 ELSE 0 END")} AS clipfrac,
       {mm("-d")} AS kl, {mm("CASE WHEN up>l3 AND adv<0 THEN 1 ELSE 0 END")} AS clipfrac_lower FROM pc""")(
    lambda spark, sf: all6(L.ppo_clip_stats(loss_tokens(spark, sf))))
C.add("gspo_stats", LT + f""", sr AS (SELECT traj_id, exp(least(sum((logp-old_logp)*mask)/greatest(sum(mask),1),10)) AS q FROM lt GROUP BY traj_id),
  sg AS (SELECT lt.*, -adv*q AS l1, -adv*greatest(least(q,1.2),0.8) AS l2 FROM lt JOIN sr USING (traj_id)),
  sm AS (SELECT sum(greatest(l1,l2)*mask)/(sum(mask)+1e-8) AS l FROM sg GROUP BY traj_id HAVING sum(mask)>0)
SELECT (SELECT round(avg(l),6)+0e0 FROM sm) AS loss, {mm("CASE WHEN l2>l1 THEN 1 ELSE 0 END")} AS clipfrac,
       {mm("old_logp-logp")} AS kl FROM sg""")(
    lambda spark, sf: all6(L.gspo_stats(loss_tokens(spark, sf))))
C.add("sapo_stats", LT + f""", sg AS (SELECT *, CASE WHEN adv>0 THEN 1e0 ELSE 1.05e0 END AS tau FROM lr),
  sm AS (SELECT sum(-adv*4/tau/(1+exp(-tau*(r-1)))*mask)/(sum(mask)+1e-8) AS l FROM sg GROUP BY traj_id HAVING sum(mask)>0)
SELECT (SELECT round(avg(l),6)+0e0 FROM sm) AS loss, {mm("-d")} AS kl FROM sg""")(
    lambda spark, sf: all6(L.sapo_stats(loss_tokens(spark, sf))))
C.add("gpg_stats", LT + f"SELECT {mm('-logp*adv')} AS loss FROM lt")(
    lambda spark, sf: all6(L.gpg_stats(loss_tokens(spark, sf))))
C.add("register_loss_stat", LT + f"SELECT {mm('-logp*adv')} AS loss FROM lt")(
    lambda spark, sf: all6(L.get_loss_stat("gpg")(loss_tokens(spark, sf))))
C.add("reinforce_stats", LT + f"""SELECT {mm('-logp*adv*least(exp(old_logp-rollout_logp),2)')} AS loss,
       {mm('rollout_logp-logp')} AS kl FROM lt""")(
    lambda spark, sf: all6(L.reinforce_stats(O.is_weights(loss_tokens(spark, sf)), is_weight="is_weight")))
C.add("cispo_stats", LT + f"""SELECT {mm('-greatest(least(r,1.2),0.8)*adv*logp')} AS loss,
       {mm('CASE WHEN r>1.2 OR r<0.8 THEN 1 ELSE 0 END')} AS clipfrac, {mm('-d')} AS kl FROM lr""")(
    lambda spark, sf: all6(L.cispo_stats(loss_tokens(spark, sf))))
C.add("geo_mean_stats", LT + """, q AS (SELECT *, greatest(least(logp-old_logp,0.2),-0.2) AS cut, sign(adv) AS sg, logp-old_logp AS raw FROM lt),
  p AS (SELECT sum(mask) AS n, sum(mask*sg*least(sg*raw,sg*cut)) AS k, sum(mask*adv) AS a, sum(-raw*mask) AS kl,
        sum(CASE WHEN raw<>cut AND adv>0 THEN mask ELSE 0 END) AS hi, sum(CASE WHEN raw<>cut AND adv<0 THEN mask ELSE 0 END) AS lo
        FROM q GROUP BY traj_id)
SELECT round(avg(-a/(n+1e-8)*exp(k/(n+1e-8))),6)+0e0 AS loss, round(sum(hi)/(sum(n)+1e-8),6)+0e0 AS clipfrac,
       round(sum(kl)/(sum(n)+1e-8),6)+0e0 AS kl, round(sum(lo)/(sum(n)+1e-8),6)+0e0 AS clipfrac_lower FROM p""")(
    lambda spark, sf: all6(L.geo_mean_stats(loss_tokens(spark, sf))))
C.add("value_loss_stats", f""", v AS (SELECT *, pow(p-token_reward,2) AS e1, pow(greatest(least(p,value+0.2),value-0.2)-token_reward,2) AS e2
  FROM (SELECT *, value+0.5*sum_pi_sq AS p FROM tokens))
SELECT {mm('0.5*greatest(e1,e2)')} AS loss, {mm('CASE WHEN e2>e1 THEN 1 ELSE 0 END')} AS clipfrac FROM v""")(
    lambda spark, sf: all6(L.value_loss_stats(
        tokens(spark, sf).withColumn("vpred", F.col("value") + 0.5 * F.col("sum_pi_sq")), returns="token_reward", clip=0.2)))

COV = LT + """, cm AS (SELECT avg(adv) AS ma, avg(logp) AS ml FROM lt WHERE mask=1),
  cv AS (SELECT lt.*, exp(logp-old_logp) AS r, (adv-ma)*(logp-ml) AS cov, md5(traj_id||'|'||t||'|0') AS h FROM lt, cm)
"""
C.add("clip_cov_stats", COV + f""", cl AS (SELECT *, -adv*r AS l1, -adv*greatest(least(r,1.2),0.8) AS l2 FROM cv),
  cand AS (SELECT traj_id, t, row_number() OVER (ORDER BY h, traj_id, t) AS rn FROM cl WHERE mask=1 AND NOT l2>l1 AND cov>0.01 AND cov<0.2),
  pick AS (SELECT traj_id, t, 0 AS z FROM cand WHERE rn <= (SELECT greatest(floor(sum(mask)*0.01),1) FROM tokens)),
  z AS (SELECT cl.*, coalesce(z,1) AS keep FROM cl LEFT JOIN pick USING (traj_id, t))
SELECT {mm('greatest(l1,l2)*keep')} AS loss, {mm('1-keep')} AS clipfrac, {mm('old_logp-logp')} AS kl FROM z""")(
    lambda spark, sf: all6(L.clip_cov_stats(loss_tokens(spark, sf), ratio=0.01, cov_low=0.01, cov_high=0.2)))
C.add("kl_cov_stats", COV + f""", rk AS (SELECT *, row_number() OVER (ORDER BY cov DESC, h, traj_id, t) AS rn FROM cv WHERE mask=1),
  k AS (SELECT greatest(1, floor(count(*)*0.02)) AS k FROM rk)
SELECT {mm('-adv*r + CASE WHEN rn<=k THEN abs(logp-old_logp) ELSE 0 END')} AS loss, {mm('abs(logp-old_logp)')} AS kl FROM rk, k""")(
    lambda spark, sf: all6(L.kl_cov_stats(loss_tokens(spark, sf), ratio=0.02)))


def bypass_rows(df):
    return rounded(df, "name", value="value")


RS_T = O.rejection_rules("token_k1,seq_mean_k3", "0.3_3.0,0.4")
C.add("bypass_stats", LT + f""", q AS (SELECT *, logp-rollout_logp AS x FROM lt),
  s AS (SELECT traj_id, sum((exp(x)-1-x)*mask)/(sum(mask)+1e-8) AS k3 FROM q GROUP BY traj_id),
  m AS (SELECT q.*, CASE WHEN mask=1 AND -x>=ln(0.3) AND -x<=ln(3.0) AND k3<=0.4 THEN 1 ELSE 0 END AS m2,
        -adv*exp(x) AS l1, -adv*greatest(least(exp(x),1.2),0.8) AS l2 FROM q JOIN s USING (traj_id))
SELECT 'actor/loss' AS name, round(sum(m2*CASE WHEN adv<0 THEN least(-adv*3,greatest(l1,l2)) ELSE greatest(l1,l2) END)/sum(m2),6)+0e0 AS value FROM m
UNION ALL SELECT 'actor/clipfrac', round(sum(CASE WHEN l2>l1 THEN m2 ELSE 0 END)/(sum(m2)+1e-8),6)+0e0 FROM m
UNION ALL SELECT 'actor/kl', round(sum(-x*m2)/(sum(m2)+1e-8),6)+0e0 FROM m
UNION ALL SELECT 'actor/clipfrac_lower', round(sum(CASE WHEN greatest(l1,l2)>-adv*3 AND adv<0 THEN m2 ELSE 0 END)/(sum(m2)+1e-8),6)+0e0 FROM m
UNION ALL SELECT 'rollout_corr/kl', round(sum(-x*mask)/(sum(mask)+1e-8),6)+0e0 FROM q
UNION ALL SELECT 'rollout_corr/rollout_rs_masked_fraction', round(sum(mask-m2)/(sum(mask)+1e-8),6)+0e0 FROM m""")(
    lambda spark, sf: bypass_rows(L.bypass_stats(loss_tokens(spark, sf), rules=RS_T)).where(
        F.col("name").startswith("actor/") | F.col("name").isin("rollout_corr/kl", "rollout_corr/rollout_rs_masked_fraction")))


def topk_tokens(spark, sf):
    return loss_tokens(spark, sf).withColumns({
        "student_topk": F.array(*[F.col("old_logp") - s for s in (1.0, 2.0, 3.0)]),
        "teacher_topk": F.array(*[F.col("rollout_logp") - s for s in (1.5, 1.0, 2.5)]),
    })


TOPK = LT + """, tk AS (SELECT *, [old_logp-1e0, old_logp-2e0, old_logp-3e0] AS s0, [rollout_logp-1.5e0, rollout_logp-1e0, rollout_logp-2.5e0] AS t0 FROM lt),
  tz AS (SELECT *, ln(list_sum(list_transform(s0, lambda x: exp(x)))) AS zs, ln(list_sum(list_transform(t0, lambda x: exp(x)))) AS zt FROM tk),
  td AS (SELECT *, {s} AS s, {t} AS q FROM tz)
"""
TAIL = {"s": "list_append(s0, ln(1-exp(least(zs,-1e-7))))", "t": "list_append(t0, ln(1-exp(least(zt,-1e-7))))"}
NORM = {"s": "list_transform(s0, lambda x: x-zs)", "t": "list_transform(t0, lambda x: x-zt)"}


def kl_sql(p, q, k):
    return "+".join(f"exp({p}[{i}])*({p}[{i}]-{q.format(i=i)})" for i in range(1, k + 1))


def topk_sql(ends, alpha, extra="1"):
    k = 4 if ends is TAIL else 3
    if alpha == 0:
        e = kl_sql("q", "s[{i}]", k)
    elif alpha == 1:
        e = kl_sql("s", "q[{i}]", k)
    else:
        mix = f"ln({1 - alpha}*exp(s[{{i}}])+{alpha}*exp(q[{{i}}]))"
        e = f"{1 - alpha}*({kl_sql('s', mix, k)})+{alpha}*({kl_sql('q', mix, k)})"
    return TOPK.format(**ends) + f"SELECT traj_id, t, round(({e})*{extra},6)+0e0 AS divergence FROM td"


for _n, _ends, _a, _kw, _x in (
    ("reverse", TAIL, 1, {}, "1"),
    ("forward", NORM, 0, {"add_tail": False}, "1"),
    ("jensen_shannon", TAIL, 0.5, {"is_clip": 1.5}, "least(exp(d),1.5)"),
):
    C.add(f"topk_divergence_{_n}", topk_sql(_ends, _a, _x))(
        lambda spark, sf, a=_a, kw=_kw: rounded(
            L.topk_divergence(topk_tokens(spark, sf), alpha=float(a), **kw), "traj_id", "t", divergence="divergence"))
C.add("distillation_loss", LT + f"SELECT {mm('(logp-rollout_logp)*logp')} AS loss FROM lt")(
    lambda spark, sf: all6(L.distillation_loss(L.sampled_divergence(loss_tokens(spark, sf), teacher="rollout_logp"))))

# ---------------------------------------------------------------- weights
WT = """, w AS (SELECT *, old_logp-rollout_logp AS x FROM tokens),
  ws AS (SELECT traj_id, sum(x*mask) AS sx, sum(mask) AS n FROM w GROUP BY traj_id)
"""
C.add("is_weights_token", WT + "SELECT traj_id, t, round(least(exp(x)*mask,2),6)+0e0 AS is_weight FROM w")(
    lambda spark, sf: rounded(O.is_weights(tokens(spark, sf)), "traj_id", "t", is_weight="is_weight"))
C.add("is_weights_token_normalized", WT + f"""SELECT traj_id, t,
  round(least(exp(x)*mask,2)/(SELECT sum(least(exp(x)*mask,2))/(sum(mask)+1e-8) FROM w),6)+0e0 AS is_weight FROM w""")(
    lambda spark, sf: rounded(O.is_weights(tokens(spark, sf), normalize=True), "traj_id", "t", is_weight="is_weight"))
C.add("is_weights_sequence_normalized", WT + """, v AS (SELECT traj_id, t, mask, n, least(exp(greatest(least(sx,20),-20))*mask,2) AS wt FROM w JOIN ws USING (traj_id)),
  sm AS (SELECT sum(wt)/(max(n)+1e-8) AS s, max(mask) AS has FROM v GROUP BY traj_id)
SELECT traj_id, t, round(wt/(SELECT sum(s*has)/sum(has) FROM sm),6)+0e0 AS is_weight FROM v""")(
    lambda spark, sf: rounded(O.is_weights(tokens(spark, sf), "sequence", normalize=True), "traj_id", "t", is_weight="is_weight"))


def is_metrics_sql(level):
    raw = "exp(x)*mask" if level == "token" else "exp(greatest(least(sx,20),-20))*mask"
    if level == "token":
        span = """max(wt) FILTER (mask=1) AS rollout_is_max, min(wt) FILTER (mask=1) AS rollout_is_min,
   count(*) FILTER (mask=1 AND wt>2)/(sum(mask)+1e-8) AS rollout_is_ratio_fraction_high,
   count(*) FILTER (mask=1 AND wt<0.5)/(sum(mask)+1e-8) AS rollout_is_ratio_fraction_low"""
    else:
        span = """(SELECT exp(least(max(sx),20)) FROM ws) AS rollout_is_max, (SELECT exp(min(sx)) FROM ws) AS rollout_is_min,
   (SELECT avg(CASE WHEN sx>ln(2) THEN 1 ELSE 0 END) FROM ws) AS rollout_is_ratio_fraction_high,
   (SELECT avg(CASE WHEN sx<ln(0.5) THEN 1 ELSE 0 END) FROM ws) AS rollout_is_ratio_fraction_low"""
    names = ["mean", "max", "min", "ratio_fraction_high", "ratio_fraction_low", "std", "eff_sample_size"]
    seqs = ["mean", "std", "max", "min", "max_deviation", "fraction_high", "fraction_low"]
    cols = ", ".join(f"round(rollout_is_{n},6)+0e0 AS rollout_is_{n}" for n in names)
    cols += ", " + ", ".join(f"round(rollout_is_seq_{n},6)+0e0 AS rollout_is_seq_{n}" for n in seqs)
    return WT + f""", v AS (SELECT traj_id, mask, {raw} AS wt, greatest(least({raw},2),0.5) AS c FROM w JOIN ws USING (traj_id)),
  g AS (SELECT sum(wt)/(sum(mask)+1e-8) AS rollout_is_mean, {span},
   sqrt(greatest(sum(c*c*mask)/(sum(mask)+1e-8) - pow(sum(c*mask)/(sum(mask)+1e-8),2),0)) AS rollout_is_std,
   pow(sum(c*mask)/(sum(mask)+1e-8)+1e-8,2)/(sum(c*c*mask)/(sum(mask)+1e-8)) AS rollout_is_eff_sample_size FROM v),
  q AS (SELECT sum(wt)/(sum(mask)+1e-8) AS s FROM v GROUP BY traj_id),
  z AS (SELECT avg(s) AS rollout_is_seq_mean, stddev_samp(s) AS rollout_is_seq_std, max(s) AS rollout_is_seq_max, min(s) AS rollout_is_seq_min,
   max(abs(s-1)) AS rollout_is_seq_max_deviation, avg(CASE WHEN s>2 THEN 1 ELSE 0 END) AS rollout_is_seq_fraction_high,
   avg(CASE WHEN s<0.5 THEN 1 ELSE 0 END) AS rollout_is_seq_fraction_low FROM q)
SELECT {cols} FROM g, z"""


for _lv in ("token", "sequence"):
    C.add(f"is_metrics_{_lv}", is_metrics_sql(_lv))(lambda spark, sf, lv=_lv: all6(O.is_metrics(tokens(spark, sf), lv)))

# ---------------------------------------------------------------- rejection
RJ = """, x0 AS (SELECT *, greatest(least(old_logp-rollout_logp,20),-20) AS x FROM tokens),
  rj AS (SELECT *, -x AS token_k1, 0.5*x*x AS token_k2, exp(x)-1-x AS token_k3,
   sum(-x*mask) OVER p AS seq_sum_k1, sum(0.5*x*x*mask) OVER p AS seq_sum_k2, sum((exp(x)-1-x)*mask) OVER p AS seq_sum_k3,
   sum(-x*mask) OVER p/(sum(mask) OVER p+1e-8) AS seq_mean_k1, sum(0.5*x*x*mask) OVER p/(sum(mask) OVER p+1e-8) AS seq_mean_k2,
   sum((exp(x)-1-x)*mask) OVER p/(sum(mask) OVER p+1e-8) AS seq_mean_k3,
   coalesce(max(CASE WHEN mask=1 THEN 0.5*x*x END) OVER p,0) AS seq_max_k2,
   coalesce(max(CASE WHEN mask=1 THEN exp(x)-1-x END) OVER p,0) AS seq_max_k3
   FROM x0 WINDOW p AS (PARTITION BY traj_id))
"""
BOUNDS = {n: ("0.71_1.37" if n.endswith("k1") else "0.0503") for n in O.REJECTION_RULES}


def keep_sql(name):
    if name.endswith("k1"):
        lo, hi = BOUNDS[name].split("_")
        return f"{name}>=ln({lo}) AND {name}<=ln({hi})"
    return f"{name}<={BOUNDS[name]}"


for _r in O.REJECTION_RULES:
    C.add(f"rejection_mask_{_r}", RJ + f"SELECT traj_id, t, CASE WHEN {keep_sql(_r)} THEN mask ELSE 0 END AS mask FROM rj")(
        lambda spark, sf, r=_r: O.rejection_mask(tokens(spark, sf), O.rejection_rules(r, BOUNDS[r])).select("traj_id", "t", "mask"))


def rs_sql(names):
    """All metrics of the named rules, long form."""
    parts = []
    keep_all = " AND ".join(f"({keep_sql(n)})" for n in names)
    for n in names:
        p, tok = f"rollout_rs_{n}", n.startswith("token")
        k1 = n.endswith("k1")
        if k1:
            lo, hi = (str(math.log(float(b))) for b in BOUNDS[n].split("_"))
        else:
            lo, hi = "0", BOUNDS[n]
        seqv = f"(SELECT sum({n}*mask)/(sum(mask)+1e-8) AS v FROM rj GROUP BY traj_id HAVING sum(mask)>0)" if tok else \
            f"(SELECT max({n}) AS v FROM rj GROUP BY traj_id HAVING sum(mask)>0)"
        cl = f"greatest(least({n},{hi}),{lo})"
        hif = f"(SELECT avg(CASE WHEN v>{hi} THEN 1 ELSE 0 END) FROM {seqv})"
        lof = f"(SELECT avg(CASE WHEN v<{lo} THEN 1 ELSE 0 END) FROM {seqv})" if k1 else "0"
        tokshare = lambda c: f"(SELECT sum(CASE WHEN {c} THEN mask ELSE 0 END)/(sum(mask)+1e-8) FROM rj)"
        m = {
            "mean": f"(SELECT sum({n}*mask)/(sum(mask)+1e-8) FROM rj)",
            "max": f"(SELECT max({n}) FROM rj WHERE mask=1)", "min": f"(SELECT min({n}) FROM rj WHERE mask=1)",
            "fraction_high": tokshare(f"{n}>{hi}") if tok else hif,
            "fraction_low": (tokshare(f"{n}<{lo}") if k1 else "0") if tok else lof,
            "std": f"(SELECT sqrt(greatest(sum({cl}*{cl}*mask)/(sum(mask)+1e-8)-pow(sum({cl}*mask)/(sum(mask)+1e-8),2),0)) FROM rj)",
            "seq_mean": f"(SELECT avg(v) FROM {seqv})", "seq_std": f"(SELECT stddev_samp(v) FROM {seqv})",
            "seq_max": f"(SELECT max(v) FROM {seqv})", "seq_min": f"(SELECT min(v) FROM {seqv})",
            "seq_max_deviation": f"(SELECT max(abs(v)) FROM {seqv})", "seq_fraction_high": hif,
            "masked_fraction": tokshare(f"NOT ({keep_sql(n)})"),
            "seq_masked_fraction": f"(SELECT avg(b) FROM (SELECT max(CASE WHEN mask=1 AND NOT ({keep_sql(n)}) THEN 1 ELSE 0 END) AS b FROM rj GROUP BY traj_id HAVING sum(mask)>0))",
        }
        if k1:
            m["seq_fraction_low"] = lof
        parts += [f"SELECT '{p}_{k}' AS name, round({v},6)+0e0 AS value" for k, v in m.items()]
    parts.append(f"SELECT 'rollout_rs_masked_fraction', round((SELECT sum(CASE WHEN {keep_all} THEN 0 ELSE mask END)/(sum(mask)+1e-8) FROM rj),6)+0e0")
    parts.append(f"SELECT 'rollout_rs_seq_masked_fraction', round((SELECT avg(b) FROM (SELECT max(CASE WHEN mask=1 AND NOT ({keep_all}) THEN 1 ELSE 0 END) AS b FROM rj GROUP BY traj_id)),6)+0e0")
    return RJ + "\nUNION ALL ".join(parts)


RS_SOME = ["token_k1", "seq_mean_k3", "seq_sum_k1", "seq_max_k2"]
C.add("rejection_metrics", rs_sql(RS_SOME))(
    lambda spark, sf: rounded(O.rejection_metrics(
        tokens(spark, sf), O.rejection_rules(",".join(RS_SOME), ",".join(BOUNDS[n] for n in RS_SOME))), "name", value="value"))

OFFP = """, o AS (SELECT traj_id, sum(mask) AS n, sum(old_logp*mask)/(sum(mask)+1e-8) AS lt, sum(rollout_logp*mask)/(sum(mask)+1e-8) AS lq,
   sum((rollout_logp-old_logp)*mask) AS kl, sum((exp(old_logp-rollout_logp)-(old_logp-rollout_logp)-1)*mask) AS k3,
   sum(exp(2*(old_logp-rollout_logp))*mask) AS rr, sum((old_logp-rollout_logp)*mask) AS slr FROM tokens GROUP BY traj_id),
  om AS (SELECT avg(exp(-lt)) AS training_ppl, avg(-lt) AS training_log_ppl, sum(kl)/(sum(n)+1e-8) AS kl, sum(k3)/(sum(n)+1e-8) AS k3_kl,
   avg(exp(-lq)) AS rollout_ppl, avg(-lq) AS rollout_log_ppl, avg(lq-lt) AS log_ppl_diff, avg(abs(lq-lt)) AS log_ppl_abs_diff,
   max(lq-lt) AS log_ppl_diff_max, min(lq-lt) AS log_ppl_diff_min, avg(exp(lq-lt)) AS ppl_ratio, sum(rr)/(sum(n)+1e-8)-1 AS chi2_token,
   avg(exp(2*greatest(least(slr,20),-20)))-1 AS chi2_seq FROM o)
"""
OFF_NAMES = ("training_ppl training_log_ppl kl k3_kl rollout_ppl rollout_log_ppl log_ppl_diff log_ppl_abs_diff "
             "log_ppl_diff_max log_ppl_diff_min ppl_ratio chi2_token chi2_seq").split()
C.add("offpolicy_metrics", OFFP + "SELECT " + ", ".join(f"round({n},6)+0e0 AS {n}" for n in OFF_NAMES) + " FROM om")(
    lambda spark, sf: all6(O.offpolicy_metrics(tokens(spark, sf))))
C.add("rollout_correction", WT + ", rj0 AS (SELECT * FROM w JOIN ws USING (traj_id))" + """
SELECT traj_id, t, CASE WHEN -x>=ln(0.5) AND -x<=ln(2.0) THEN mask ELSE 0 END AS mask, round(least(exp(x)*mask,2),6)+0e0 AS is_weight FROM rj0""")(
    lambda spark, sf: rounded(O.rollout_correction(
        tokens(spark, sf), "token", 2.0, rules=O.rejection_rules("token_k1", 2.0))[0], "traj_id", "t", "mask", is_weight="is_weight"))
C.add("rollout_correction_metrics", OFFP + "\nUNION ALL ".join(
    f"SELECT 'rollout_corr/{n}' AS name, round({n},6)+0e0 AS value FROM om" for n in OFF_NAMES))(
    lambda spark, sf: rounded(O.rollout_correction(tokens(spark, sf))[1], "name", value="value"))
C.add("bypass_logprobs", "SELECT traj_id, t, round(rollout_logp,6)+0e0 AS old_logp FROM tokens")(
    lambda spark, sf: rounded(O.bypass_logprobs(tokens(spark, sf)), "traj_id", "t", old_logp="old_logp"))
C.add("logprob_drift", """, d AS (SELECT exp(old_logp) AS a, exp(rollout_logp) AS b FROM tokens WHERE mask=1)
SELECT round(max(abs(a-b)),6)+0e0 AS diff_max, round(avg(abs(a-b)),6)+0e0 AS diff_mean, round(stddev_samp(abs(a-b)),6)+0e0 AS diff_std,
       round(corr(a,b),6)+0e0 AS pearson FROM d""")(lambda spark, sf: all6(O.logprob_drift(tokens(spark, sf))))
C.add("token_mismatch", "SELECT traj_id, count(*) FILTER (mask=1 AND old_logp<>rollout_logp) AS mismatches FROM tokens GROUP BY traj_id")(
    lambda spark, sf: O.token_mismatch(tokens(spark, sf), "old_logp", "rollout_logp"))
C.add("variance_proxy", LT + """, p AS (SELECT sum(adv*mask)/(sum(mask)+1e-8) AS a, sum((1-2*exp(old_logp)+sum_pi_sq)*mask) AS w FROM lt GROUP BY traj_id),
  g AS (SELECT avg(a*a*greatest(w,0)) AS p2, avg(a*a) AS a2, avg(w) AS ew, count(*) AS n FROM p)
SELECT 0.0025e0 AS proxy1_signal_strength, round(p2,6)+0e0 AS proxy2_total_power, round(greatest((p2-0.0025)/(n-1),0),6)+0e0 AS proxy3_pure_noise,
       round(a2,6)+0e0 AS expected_a_squared, round(ew,6)+0e0 AS expected_w FROM g""")(
    lambda spark, sf: all6(O.variance_proxy(loss_tokens(spark, sf), grad_norm=0.05)))
C.add("variance_proxy_weighted", LT + """, wv AS (SELECT *, least(exp(old_logp-rollout_logp),2)*mask AS wt FROM lt),
  p AS (SELECT sum(adv*mask)/(sum(mask)+1e-8) AS a, sum((1-2*exp(old_logp)+sum_pi_sq)*wt*wt*mask) AS w,
        sum((1-2*exp(old_logp)+sum_pi_sq)*wt*wt/greatest(wt*wt,1e-10)*mask) AS w0, sum(wt*mask)/(sum(mask)+1e-8) AS rho FROM wv GROUP BY traj_id)
SELECT 0e0 AS proxy1_signal_strength, round(avg(rho*rho*a*a*greatest(w0,0)),6)+0e0 AS proxy2_total_power, 0e0 AS proxy3_pure_noise,
       round(avg(a*a),6)+0e0 AS expected_a_squared, round(avg(w),6)+0e0 AS expected_w FROM p""")(
    lambda spark, sf: all6(O.variance_proxy(O.is_weights(loss_tokens(spark, sf)), is_weight="is_weight")))
