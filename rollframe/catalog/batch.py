"""Checks of row algebra, token shaping and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import r6, rounded
from ..operators import algebra as B
from ..operators import packing as P
from ..operators import shape as S
from ..plans.views import rollouts, table, tokens
from .oracle import CATALOG as C

POS = """, ps AS (SELECT *, row_number() OVER (ORDER BY traj_id)-1 AS pos, count(*) OVER () AS n FROM rollouts)
"""


def text(arr):
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")


C.add("select_columns", "SELECT uid, traj_id FROM rollouts")(
    lambda spark, sf: B.select_columns(rollouts(spark, sf), ["uid", "traj_id"]))
C.add("drop_columns", "SELECT traj_id, pred FROM rollouts")(
    lambda spark, sf: B.drop_columns(rollouts(spark, sf), ["uid", "data_source", "score", "acc", "response_len", "param_version"]))
C.add("pop", "SELECT traj_id, data_source, pred FROM rollouts")(
    lambda spark, sf: B.pop(rollouts(spark, sf), ["uid", "score", "acc", "response_len", "param_version"])[1])
C.add("rename_columns", "SELECT uid AS prompt_id, traj_id AS rollout_id FROM rollouts")(
    lambda spark, sf: B.rename_columns(rollouts(spark, sf).select("uid", "traj_id"), ["uid", "traj_id"], ["prompt_id", "rollout_id"]))
C.add("prefix_columns", "SELECT uid AS val_uid, traj_id AS traj_id, pred AS val_pred FROM rollouts")(
    lambda spark, sf: B.prefix_columns(rollouts(spark, sf).select("uid", "traj_id", "pred"), "val_", keep=["traj_id"]))


@C.add("select_rows", POS + """, w AS (SELECT event_id AS pick_no, user_id*7 AS pos FROM events)
SELECT pick_no, traj_id FROM w JOIN ps USING (pos)""")
def _(spark, sf):
    wanted = table(spark, sf, "events").select(F.col("event_id").alias("pick_no"), (F.col("user_id") * 7).alias("pos"))
    return B.select_rows(rollouts(spark, sf), "traj_id", wanted).select("pick_no", "traj_id")


C.add("select_rows_mask", "SELECT traj_id FROM rollouts WHERE score>0.5")(
    lambda spark, sf: B.select_rows(rollouts(spark, sf), "traj_id", F.col("score") > 0.5).select("traj_id"))
C.add("slice_rows", POS + "SELECT traj_id, pos FROM ps WHERE pos>=100 AND pos<n-50 AND (pos-100)%3=0")(
    lambda spark, sf: B.slice_rows(rollouts(spark, sf), "traj_id", 100, -50, 3).select("traj_id", "pos"))
C.add("union_columns", """SELECT o_orderkey AS traj_id, o_custkey AS uid, round(o_totalprice,6)+0e0 AS price, o_orderstatus AS status FROM orders""")(
    lambda spark, sf: rounded(B.union_columns(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("traj_id"), F.col("o_custkey").alias("uid"), F.col("o_totalprice").alias("price")),
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("traj_id"), F.col("o_custkey").alias("uid"), F.col("o_orderstatus").alias("status")),
        "traj_id"), "traj_id", "uid", "status", price="price"))
C.add("concat_rows", "SELECT traj_id, score FROM rollouts WHERE score>=1 UNION ALL SELECT traj_id, score FROM rollouts WHERE score<1")(
    lambda spark, sf: B.concat_rows(rollouts(spark, sf).where("score >= 1"), rollouts(spark, sf).where("score < 1")).select("traj_id", "score"))


def meta(spark, sf, kind):
    e = table(spark, sf, "events").where(F.col("event_type") == kind)
    both = e.agg(F.array(
        F.struct(F.lit("metrics").alias("name"), F.count(F.lit(1)).cast("string").alias("value")),
        F.struct(F.lit("first_day").alias("name"), F.min(F.dayofmonth("ts")).cast("string").alias("value"))).alias("m"))
    return both.select(F.inline("m"))


KINDS = ["click", "error", "purchase", "signup", "view"]
C.add("concat_meta", """SELECT 'first_day' AS name, CAST(min(dayofmonth(ts)) AS VARCHAR) AS value, 0 AS part FROM events
UNION ALL SELECT 'metrics', CAST(count(*) AS VARCHAR), CAST(dense_rank() OVER (ORDER BY event_type)-1 AS INTEGER) FROM events GROUP BY event_type""")(
    lambda spark, sf: B.concat_meta(*[meta(spark, sf, k) for k in KINDS]))
C.add("chunk", POS + "SELECT traj_id, CAST(pos//CAST(ceil(n/8.0) AS BIGINT) AS BIGINT) AS chunk_id FROM ps")(
    lambda spark, sf: B.chunk(rollouts(spark, sf), "traj_id", 8, even=False).select("traj_id", "chunk_id"))
C.add("split", POS + "SELECT traj_id, CAST(pos//64 AS BIGINT) AS chunk_id FROM ps")(
    lambda spark, sf: B.split(rollouts(spark, sf), "traj_id", 64).select("traj_id", "chunk_id"))
C.add("pad_to_divisor", POS + """SELECT pos, traj_id, false AS is_pad FROM ps
UNION ALL SELECT n+pos, traj_id, true FROM ps WHERE pos < (64-n%64)%64""")(
    lambda spark, sf: B.pad_to_divisor(rollouts(spark, sf), "traj_id", 64).select("pos", "traj_id", "is_pad"))
C.add("unpad", POS + "SELECT pos, traj_id FROM ps")(
    lambda spark, sf: B.unpad(B.pad_to_divisor(rollouts(spark, sf), "traj_id", 64)).select("pos", "traj_id"))


@C.add("reorder", POS + "SELECT traj_id, n-1-pos AS pos FROM ps")
def _(spark, sf):
    r = rollouts(spark, sf)
    n = r.agg(F.count(F.lit(1))).scalar()
    perm = B.positions(r, "traj_id", "old_pos").select("old_pos", (n - 1 - F.col("old_pos")).alias("new_pos"))
    return B.reorder(r, "traj_id", perm).select("traj_id", "pos")


C.add("repeat_rows", POS + "SELECT traj_id, pos*3+c AS pos, c AS copy FROM ps, (SELECT unnest([0,1,2]::BIGINT[]) AS c)")(
    lambda spark, sf: B.repeat_rows(rollouts(spark, sf), "traj_id", 3).select("traj_id", "pos", "copy"))
C.add("repeat_rows_block", POS + "SELECT traj_id, c*n+pos AS pos, c AS copy FROM ps, (SELECT unnest([0,1,2]::BIGINT[]) AS c)")(
    lambda spark, sf: B.repeat_rows(rollouts(spark, sf), "traj_id", 3, interleave=False).select("traj_id", "pos", "copy"))
C.add("repeat_rows_by", "SELECT traj_id, unnest(range(response_len)) AS copy FROM rollouts WHERE response_len>0")(
    lambda spark, sf: B.repeat_rows_by(rollouts(spark, sf), "response_len").select("traj_id", "copy"))
C.add("fold_rows", POS + """SELECT CAST(pos//(n//100) AS BIGINT) AS fold_id, string_agg(CAST(traj_id AS VARCHAR), ',' ORDER BY pos) AS ids,
  string_agg(pred, ',' ORDER BY pos) AS preds FROM ps GROUP BY 1""")(
    lambda spark, sf: B.fold_rows(rollouts(spark, sf), "traj_id", 100, ["traj_id", "pred"]).select(
        "fold_id", text("traj_id").alias("ids"), text("pred").alias("preds")))
C.add("unfold_rows", POS + "SELECT CAST(pos//(n//100) AS BIGINT) AS fold_id, CAST(pos%(n//100) AS INTEGER) AS item_no, traj_id, pred FROM ps")(
    lambda spark, sf: B.unfold_rows(B.fold_rows(rollouts(spark, sf), "traj_id", 100, ["traj_id", "pred"]), ["traj_id", "pred"]))
C.add("unfold_column_chunks", """, e AS (SELECT vec_id, label, unnest(range(4)) AS k, embedding FROM embeddings)
SELECT vec_id, label, CAST(k AS INTEGER) AS piece_no, round(list_sum(list_transform(embedding[k*16+1:k*16+16], lambda x: CAST(x AS DOUBLE))),6)+0e0 AS total FROM e""")(
    lambda spark, sf: B.unfold_column_chunks(table(spark, sf, "embeddings"), 4, ["embedding"]).select(
        "vec_id", "label", "piece_no", r6(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("total")))
C.add("minibatches", """, e AS (SELECT traj_id, CAST(unnest([0,1]) AS INTEGER) AS epoch FROM rollouts)
SELECT traj_id, epoch, CAST((row_number() OVER (PARTITION BY epoch ORDER BY md5(traj_id||'|'||epoch||'|7'), traj_id)-1)//100 AS BIGINT) AS batch_id FROM e""")(
    lambda spark, sf: B.minibatches(rollouts(spark, sf), "traj_id", 100, 2, 7).select("traj_id", "epoch", "batch_id"))
C.add("minibatches_in_order", POS + "SELECT traj_id, 0 AS epoch, CAST(pos//50 AS BIGINT) AS batch_id FROM ps")(
    lambda spark, sf: B.minibatches(rollouts(spark, sf), "traj_id", 50).select("traj_id", "epoch", "batch_id"))
C.add("collate", POS + """SELECT CAST(pos//64 AS BIGINT) AS chunk_id, string_agg(CAST(uid AS VARCHAR), ',' ORDER BY traj_id) AS uids,
  string_agg(data_source, ',' ORDER BY traj_id) AS sources FROM ps GROUP BY 1""")(
    lambda spark, sf: B.collate(B.split(rollouts(spark, sf), "traj_id", 64), "chunk_id", "traj_id", ["uid", "data_source"]).select(
        "chunk_id", text("uid").alias("uids"), text("data_source").alias("sources")))
C.add("columns_to_rows", POS + "SELECT CAST(pos//64 AS BIGINT) AS chunk_id, uid, data_source FROM ps")(
    lambda spark, sf: B.columns_to_rows(B.collate(
        B.split(rollouts(spark, sf), "traj_id", 64), "chunk_id", "traj_id", ["uid", "data_source"]), ["chunk_id"], ["uid", "data_source"]))
C.add("batch_summary", """SELECT 'vec_id' AS "column", 'bigint' AS type, count(*) AS rows, count(*) AS items, round(count(*)*8/pow(1024,3),6)+0e0 AS gb FROM embeddings
UNION ALL SELECT 'embedding', 'array<float>', count(*), CAST(sum(len(embedding)) AS BIGINT), round(sum(len(embedding))*4/pow(1024,3),6)+0e0 FROM embeddings
UNION ALL SELECT 'label', 'int', count(*), count(*), round(count(*)*4/pow(1024,3),6)+0e0 FROM embeddings""")(
    lambda spark, sf: rounded(B.batch_summary(table(spark, sf, "embeddings")), "column", "type", "rows", "items", gb="gb"))
C.add("frames_equal", "SELECT count(*)=0 AS equal FROM (SELECT traj_id, t FROM tokens EXCEPT ALL SELECT traj_id, t FROM tokens ORDER BY 1)")(
    lambda spark, sf: B.frames_equal(tokens(spark, sf).select("traj_id", "t"), tokens(spark, sf).repartition(5).select("traj_id", "t")))
C.add("frames_diff", """SELECT lang, CAST(count(*) FILTER (doc_id%2=0)-count(*) FILTER (doc_id%2=1) AS BIGINT) AS surplus FROM documents GROUP BY lang
HAVING count(*) FILTER (doc_id%2=0)<>count(*) FILTER (doc_id%2=1)""")(
    lambda spark, sf: B.frames_diff(
        table(spark, sf, "documents").where("doc_id % 2 = 0").select("lang"), table(spark, sf, "documents").where("doc_id % 2 = 1").select("lang")))

# ---------------------------------------------------------------- token shaping
WORDS = """, cw AS (SELECT conv_id, turn, role, list_transform(string_split(text,' '), lambda w: CAST(length(w) AS INTEGER)) AS ids FROM conversations),
  tw AS (SELECT doc_id AS traj_id, list_transform(string_split(text,' '), lambda w: CAST(length(w) AS INTEGER)) AS ids FROM documents),
  tl AS (SELECT traj_id, unnest(ids) AS token, unnest(range(len(ids)))+1 AS t FROM tw)
"""


def ids_of(c):
    """Word lengths stand in for token ids."""
    return F.transform(F.split(c, " "), lambda w: F.length(w))


def doc_tokens(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("traj_id"), F.posexplode(ids_of("text")).alias("t", "token")).withColumn(
        "t", F.col("t").cast("long") + 1)


C.add("response_mask", WORDS + """SELECT traj_id, t, CASE WHEN coalesce(sum(CASE WHEN token IN (11,12) THEN 1 ELSE 0 END) OVER
   (PARTITION BY traj_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)=0 THEN 1 ELSE 0 END AS mask FROM tl""")(
    lambda spark, sf: S.response_mask(doc_tokens(spark, sf), [11, 12]).select("traj_id", "t", "mask"))
C.add("response_slice_mask", """, m AS (SELECT traj_id, list(mask ORDER BY t) AS m FROM tokens GROUP BY traj_id)
SELECT traj_id, array_to_string(m[greatest(len(m)-3,0)+1:],',') AS mask FROM m""")(
    lambda spark, sf: tokens(spark, sf).groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("t", "mask"))).alias("m")).select(
        "traj_id", text(S.response_slice_mask(F.col("m.mask"), 3)).alias("mask")))
C.add("position_ids", "SELECT traj_id, t, CAST(greatest(sum(mask) OVER (PARTITION BY traj_id ORDER BY t)-1,0) AS BIGINT) AS position_id FROM tokens")(
    lambda spark, sf: S.position_ids(tokens(spark, sf)).select("traj_id", "t", "position_id"))
for _mode, _cut in (("left", "ids[len(ids)-39:]"), ("right", "ids[1:40]"), ("middle", "list_concat(ids[1:20], ids[len(ids)-19:])")):
    C.add(f"pad_truncate_{_mode}", WORDS + f"""SELECT conv_id, turn, array_to_string(CASE WHEN len(ids)>40 THEN {_cut}
      ELSE list_concat(list_transform(range(40-len(ids)), lambda x: 0), ids) END,',') AS ids FROM cw""")(
        lambda spark, sf, m=_mode: table(spark, sf, "conversations").select(
            "conv_id", "turn", text(S.pad_truncate(ids_of("text"), 40, 0, True, m)).alias("ids")))
C.add("strip_padding", """, m AS (SELECT traj_id, list(t ORDER BY t) FILTER (mask=1) AS ids FROM tokens GROUP BY traj_id)
SELECT traj_id, coalesce(array_to_string(ids,','),'') AS ids FROM m""")(
    lambda spark, sf: tokens(spark, sf).groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("t", "mask"))).alias("m")).select(
        "traj_id", F.col("m.t").alias("ids"), F.col("m.mask").alias("mask")).select("traj_id", text(S.strip_padding("ids", "mask")).alias("ids")))
C.add("pack_valid_tokens", "SELECT traj_id, t, row_number() OVER (ORDER BY traj_id, t)-1 AS flat_idx FROM tokens WHERE mask=1")(
    lambda spark, sf: S.pack_valid_tokens(tokens(spark, sf))[0].select("traj_id", "t", "flat_idx"))
C.add("pack_row_starts", """, l AS (SELECT traj_id, CAST(sum(mask) AS BIGINT) AS row_len FROM tokens GROUP BY traj_id)
SELECT traj_id, CAST(sum(row_len) OVER (ORDER BY traj_id)-row_len AS BIGINT) AS row_start, row_len FROM l""")(
    lambda spark, sf: S.pack_valid_tokens(tokens(spark, sf))[1].select("traj_id", "row_start", "row_len"))


@C.add("unpack_tokens", "SELECT traj_id, t, round(CASE WHEN mask=1 THEN value ELSE 0 END,6)+0e0 AS value FROM tokens")
def _(spark, sf):
    t = tokens(spark, sf)
    flat, _ = S.pack_valid_tokens(t)
    return rounded(S.unpack_tokens(t.drop("value"), flat, "value"), "traj_id", "t", value="value")


SFT = WORDS + """, q AS (SELECT a.conv_id, a.turn, a.ids AS p, b.ids AS r, len(a.ids) AS pl, len(b.ids) AS rl FROM cw a JOIN cw b ON a.conv_id=b.conv_id AND b.turn=a.turn+1),
  c AS (SELECT *, list_concat(p,r)[1:120] AS ids, least(pl+rl,120) AS n FROM q)
"""


def pairs(spark, sf):
    """Every turn as a prompt with the next turn as its response."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", ids_of("text").alias("ids"))
    a = c.select("conv_id", "turn", F.col("ids").alias("prompt_ids"))
    return a.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("response_ids")), ["conv_id", "turn"])


C.add("sft_loss_mask", SFT + """SELECT conv_id, turn, array_to_string(list_concat(ids, list_transform(range(120-n), lambda x: 0)),',') AS input_ids,
  array_to_string(list_transform(range(120), lambda i: CASE WHEN i<n THEN 1 ELSE 0 END),',') AS attention_mask,
  array_to_string(list_transform(range(120), lambda i: CASE WHEN i<least(pl,120)-1 OR i=n-1 OR i>=n THEN 0 ELSE 1 END),',') AS loss_mask,
  array_to_string(list_transform(range(120), lambda i: least(i,n-1)),',') AS position_ids FROM c""")(
    lambda spark, sf: S.sft_loss_mask(pairs(spark, sf), max_len=120, truncation="right").select(
        "conv_id", "turn", *[text(c).alias(c) for c in ("input_ids", "attention_mask", "loss_mask", "position_ids")]))
C.add("preference_pair_arrays", SFT + """, d AS (SELECT conv_id, turn, list_concat(p, r, [99]) AS x, list_concat(p, p, [99]) AS y FROM c)
SELECT conv_id, turn, array_to_string(list_concat(x, list_transform(range(greatest(150-len(x),0)), lambda i: 0))[1:150],',') AS chosen,
  array_to_string(list_concat(y, list_transform(range(greatest(150-len(y),0)), lambda i: 0))[1:150],',') AS rejected,
  array_to_string(list_transform(range(150), lambda i: CASE WHEN i<len(y) THEN 1 ELSE 0 END),',') AS rejected_mask FROM d""")(
    lambda spark, sf: S.preference_pair_arrays(
        pairs(spark, sf).withColumnRenamed("response_ids", "chosen_ids").withColumn("rejected_ids", F.col("prompt_ids")), 150, 99).select(
        "conv_id", "turn", text(F.col("input_ids")[0]).alias("chosen"), text(F.col("input_ids")[1]).alias("rejected"),
        text(F.col("attention_mask")[1]).alias("rejected_mask")))
MT = WORDS + """, fl AS (SELECT conv_id, turn, role, unnest(ids) AS tok, unnest(range(len(ids))) AS i FROM cw),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i)-1 AS p, count(*) OVER (PARTITION BY conv_id) AS n,
        CASE WHEN role='assistant' AND i>=2 THEN 1 ELSE 0 END AS lm FROM fl)
"""
for _mode, _lo in (("right", "0"), ("left", "greatest(n-300,0)")):
    C.add(f"multiturn_loss_mask_{_mode}", MT + f""", k AS (SELECT conv_id, n, list(tok ORDER BY p) AS ids, list(lm ORDER BY p) AS lm, list(p ORDER BY p) AS pos
      FROM o WHERE p>={_lo} AND p<{_lo}+300 GROUP BY conv_id, n)
    SELECT conv_id, array_to_string(list_concat(ids, list_transform(range(300-len(ids)), lambda x: 0)),',') AS input_ids,
      array_to_string(list_concat(lm, list_transform(range(300-len(ids)), lambda x: 0)),',') AS loss_mask,
      array_to_string(list_concat(pos, list_transform(range(300-len(ids)), lambda x: 0)),',') AS position_ids,
      array_to_string(list_transform(range(300), lambda i: CASE WHEN i<len(ids) THEN 1 ELSE 0 END),',') AS attention_mask FROM k""")(
        lambda spark, sf, m=_mode: S.multiturn_loss_mask(
            table(spark, sf, "conversations").withColumn("ids", ids_of("text")), 300, truncation=m, prefix_len=2).select(
            "conv_id", *[text(c).alias(c) for c in ("input_ids", "attention_mask", "loss_mask", "position_ids")]))
C.add("segments_to_response_mask", MT + "SELECT conv_id, p+1 AS t, tok AS token, CASE WHEN role='assistant' THEN 1 ELSE 0 END AS mask FROM o WHERE p<200")(
    lambda spark, sf: S.segments_to_response_mask(
        table(spark, sf, "conversations").withColumn("ids", ids_of("text")).withColumn("is_model", F.col("role") == "assistant"), 200))
C.add("assemble_rollout_rows", """SELECT traj_id, score, pred, false AS use_score FROM rollouts WHERE param_version<3
UNION ALL SELECT traj_id, NULL, NULL, false FROM rollouts WHERE param_version>=3""")(
    lambda spark, sf: S.assemble_rollout_rows(
        rollouts(spark, sf).where("param_version < 3").select("traj_id", "score", "pred"),
        rollouts(spark, sf).where("param_version >= 3").select("traj_id")))
C.add("token_reward_at_end", "SELECT traj_id, t, round(token_reward,6)+0e0 AS token_reward FROM tokens")(
    lambda spark, sf: rounded(S.token_reward_at_end(tokens(spark, sf), rollouts(spark, sf)), "traj_id", "t", token_reward="token_reward"))
C.add("overlong_penalty", """SELECT traj_id, round(least(-(response_len-(7-3))/3e0*0.5,0),6)+0e0 AS overlong_reward, response_len>4 AS overlong,
  round(score+least(-(response_len-(7-3))/3e0*0.5,0),6)+0e0 AS score FROM rollouts""")(
    lambda spark, sf: rounded(S.overlong_penalty(rollouts(spark, sf), 7, 3, 0.5), "traj_id", "overlong", overlong_reward="overlong_reward", score="score"))
C.add("group_index", "SELECT traj_id, dense_rank() OVER (ORDER BY uid)-1 AS group_no FROM rollouts")(
    lambda spark, sf: S.group_index(rollouts(spark, sf), "uid").select("traj_id", "group_no"))
C.add("group_index_text", """, l AS (SELECT DISTINCT data_source, md5(data_source||'|0') AS h FROM rollouts), n AS (SELECT data_source, row_number() OVER (ORDER BY h)-1 AS group_no FROM l)
SELECT traj_id, group_no FROM rollouts JOIN n USING (data_source)""")(
    lambda spark, sf: S.group_index(rollouts(spark, sf), "data_source").select("traj_id", "group_no"))
C.add("rollout_number", "SELECT traj_id, sample_idx AS rollout_no FROM rollouts")(
    lambda spark, sf: S.rollout_number(rollouts(spark, sf)).select("traj_id", "rollout_no"))

# ---------------------------------------------------------------- packing
BT = """, bt AS (SELECT *, (row_number() OVER (ORDER BY traj_id)-1)//64 AS batch_id, row_number() OVER (ORDER BY traj_id)-1 AS pos FROM rollouts)
"""


def batched(spark, sf, size=64):
    return B.split(rollouts(spark, sf), "traj_id", size).withColumnRenamed("chunk_id", "batch_id")


def whole_batches(spark, sf, size):
    """Batches of ``size`` rows, the last one filled up with copies from the start under new ids."""
    d = B.pad_to_divisor(rollouts(spark, sf), "traj_id", size)
    return d.withColumn("batch_id", F.expr(f"pos div {size}")).drop("traj_id").withColumnRenamed("pos", "traj_id")


C.add("attention_workload", "SELECT traj_id, 24576*response_len+response_len*response_len AS workload FROM rollouts")(
    lambda spark, sf: rollouts(spark, sf).select("traj_id", P.attention_workload("response_len").alias("workload")))
C.add("serpentine_partitions", """, r AS (SELECT traj_id, row_number() OVER (ORDER BY response_len DESC, traj_id)-1 AS r FROM rollouts)
SELECT traj_id, CAST(CASE WHEN (r//8)%2=0 THEN r%8 ELSE 7-r%8 END AS BIGINT) AS part FROM r""")(
    lambda spark, sf: P.serpentine_partitions(rollouts(spark, sf), 8, "response_len", "traj_id").select("traj_id", "part"))


def part_checks(d, weight, keys=("batch_id",), part="part"):
    """What must hold for a placement, per batch: parts, rows per part, every row once, total, and the spread of the sums."""
    per = d.groupBy(*keys, part).agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight).alias("s"), F.max(weight).alias("w"), F.count_distinct("traj_id").alias("ids"))
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("parts"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.sum("s").alias("total"),
        (F.max("s") - F.min("s") <= F.max("w")).alias("even"), (F.min(part) == 0).alias("from_zero"), (F.max(part) + 1).alias("numbers"),
        F.sum("n").alias("n_rows"), F.sum("ids").alias("n_ids"),
    )


WB = """, fb AS (SELECT i AS pos, r.response_len, i//64 AS batch_id FROM (SELECT count(*) AS n FROM rollouts) c, range(0, (SELECT CAST(ceil(count(*)/64.0)*64 AS BIGINT) FROM rollouts)) g(i)
  JOIN (SELECT *, row_number() OVER (ORDER BY traj_id)-1 AS p FROM rollouts) r ON r.p = g.i % c.n)"""
# equal parts of whole batches: everything but the placement itself is known
C.add("balance_partitions", WB + """SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(4 AS BIGINT) AS parts, CAST(16 AS BIGINT) AS fewest, CAST(16 AS BIGINT) AS most,
  CAST(sum(response_len) AS BIGINT) AS total, true AS even, true AS from_zero, CAST(4 AS BIGINT) AS numbers, count(*) AS n_rows, count(*) AS n_ids FROM fb GROUP BY batch_id""")(
    lambda spark, sf: part_checks(P.balance_partitions(whole_batches(spark, sf, 64), 4, "response_len"), "response_len"))
C.add("balance_partitions_uneven", BT + """SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(4 AS BIGINT) AS parts, CAST(sum(response_len) AS BIGINT) AS total, true AS even, true AS from_zero,
  CAST(4 AS BIGINT) AS numbers, count(*) AS n_rows, count(*) AS n_ids FROM bt GROUP BY batch_id""")(
    lambda spark, sf: part_checks(P.balance_partitions(batched(spark, sf), 4, "response_len", equal_size=False), "response_len").drop("fewest", "most"))
# eight rows in four equal parts: differencing pairs the i-th lightest with the i-th heaviest
@C.add("balance_partitions_pairs", """, e AS (SELECT *, (row_number() OVER (ORDER BY traj_id)-1)//8 AS batch_id FROM rollouts),
  r AS (SELECT batch_id, traj_id, row_number() OVER (PARTITION BY batch_id ORDER BY response_len, traj_id) AS r, count(*) OVER (PARTITION BY batch_id) AS n FROM e)
SELECT CAST(a.batch_id AS BIGINT) AS batch_id, a.traj_id, b.traj_id AS partner FROM r a JOIN r b ON a.batch_id=b.batch_id AND a.r+b.r=9 WHERE a.n=8""")
def _(spark, sf):
    d = batched(spark, sf, 8)
    whole = d.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).where("n = 8").select("batch_id")
    d = P.balance_partitions(d.join(whole, "batch_id"), 4, "response_len")
    both = d.groupBy("batch_id", "part").agg(F.sum("traj_id").alias("s"))
    return d.join(both, ["batch_id", "part"]).select("batch_id", "traj_id", (F.col("s") - F.col("traj_id")).alias("partner"))


C.add("balance_partitions_large", """, b AS (SELECT traj_id, response_len, (row_number() OVER (ORDER BY traj_id)-1)//1000 AS batch_id FROM rollouts),
  r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY response_len DESC, traj_id)-1 AS r FROM b)
SELECT CAST(batch_id AS BIGINT) AS batch_id, traj_id, CAST(CASE WHEN (r//4)%2=0 THEN r%4 ELSE 3-r%4 END AS BIGINT) AS part FROM r""")(
    lambda spark, sf: P.balance_partitions(batched(spark, sf, 1000), 4, "response_len", equal_size=False, method="serpentine").select("batch_id", "traj_id", "part"))
C.add("balance_partitions_blocks", """, b AS (SELECT traj_id, response_len, (row_number() OVER (ORDER BY traj_id)-1)//1000 AS batch_id FROM rollouts)
SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(4 AS BIGINT) AS parts, CAST(sum(response_len) AS BIGINT) AS total, true AS even, true AS from_zero,
  CAST(4 AS BIGINT) AS numbers, count(*) AS n_rows, count(*) AS n_ids FROM b GROUP BY batch_id""")(
    lambda spark, sf: part_checks(P.balance_partitions(
        batched(spark, sf, 1000), 4, "response_len", equal_size=False, method="blocks", block_rows=96), "response_len").drop("fewest", "most"))
C.add("greedy_partitions", """, gb AS (SELECT traj_id, CAST(response_len AS BIGINT) AS w, (row_number() OVER (ORDER BY traj_id)-1)//64 AS batch_id, (row_number() OVER (ORDER BY traj_id)-1)%64 AS i FROM rollouts),
  st AS (SELECT batch_id, 0 AS i, [0,0,0,0]::BIGINT[] AS load, NULL::BIGINT AS part, NULL::BIGINT AS traj_id FROM gb GROUP BY batch_id),
  rc AS (WITH RECURSIVE r AS (SELECT * FROM st UNION ALL
     SELECT r.batch_id, r.i+1, list_transform(r.load, lambda x, j: x + CASE WHEN j=list_position(r.load, list_min(r.load)) THEN gb.w ELSE 0 END),
            list_position(r.load, list_min(r.load))-1, gb.traj_id FROM r JOIN gb ON gb.batch_id=r.batch_id AND gb.i=r.i) SELECT * FROM r)
SELECT CAST(batch_id AS BIGINT) AS batch_id, traj_id, CAST(part AS BIGINT) AS part FROM rc WHERE traj_id IS NOT NULL""")(lambda spark, sf: P.greedy_partitions(batched(spark, sf), 4, "response_len").select("batch_id", "traj_id", "part"))
@C.add("group_balance", """, g AS (SELECT uid//100 AS batch_id, uid%100%10 AS u, traj_id, response_len, 24576*response_len+response_len*response_len AS w FROM rollouts),
  s AS (SELECT batch_id, u, sum(w) AS w FROM g GROUP BY ALL)
SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(2 AS BIGINT) AS parts, CAST(count(DISTINCT u)//2 AS BIGINT) AS fewest, CAST(count(DISTINCT u)//2 AS BIGINT) AS most,
  CAST(sum(w) AS BIGINT) AS total, true AS even, true AS from_zero, CAST(2 AS BIGINT) AS numbers, CAST(count(DISTINCT u) AS BIGINT) AS n_rows, CAST(count(DISTINCT u) AS BIGINT) AS n_ids
FROM s GROUP BY batch_id""")
def _(spark, sf):
    d = rollouts(spark, sf).withColumn("batch_id", F.expr("uid div 100")).withColumn("uid", F.col("uid") % 100 % 10)
    d = P.group_balance(d, 2, "response_len").withColumn("w", P.attention_workload("response_len"))
    # one row per uid and part: a uid in two parts would show as two rows of one id
    return part_checks(d.groupBy("batch_id", "part", F.col("uid").alias("traj_id")).agg(F.sum("w").alias("w")), "w")


C.add("pack_microbatches", BT + """, s AS (SELECT batch_id, count(*) AS n, CAST(sum(response_len) AS BIGINT) AS t, sum(24576*response_len+response_len*response_len) AS w FROM bt GROUP BY batch_id),
  k AS (SELECT *, CAST(ceil(greatest(least(n, ceil(t/40.0)), 1)/2.0)*2 AS BIGINT) AS parts FROM s)
SELECT CAST(batch_id AS BIGINT) AS batch_id, parts, CAST(w AS BIGINT) AS total, true AS even, true AS from_zero, parts AS numbers, n AS n_rows, n AS n_ids FROM k""")(
    lambda spark, sf: part_checks(
        P.pack_microbatches(batched(spark, sf), 40, "response_len", multiple=2).withColumn("w", P.attention_workload("response_len")), "w", part="micro_id"
    ).drop("fewest", "most"))
C.add("restore_order", BT + "SELECT traj_id, pos FROM bt")(
    lambda spark, sf: P.restore_order(P.pack_microbatches(batched(spark, sf), 40, "response_len")).select("traj_id", "pos"))
C.add("run_order", BT + """, p AS (SELECT traj_id, batch_id, traj_id%4 AS part, row_number() OVER (PARTITION BY batch_id, traj_id%4 ORDER BY response_len, traj_id)-1 AS r,
   count(*) OVER (PARTITION BY batch_id, traj_id%4) AS n FROM bt)
SELECT traj_id, part, CAST(CASE WHEN r%2=0 THEN r//2 ELSE n-1-r//2 END AS BIGINT) AS slot FROM p""")(
    lambda spark, sf: P.run_order(batched(spark, sf).withColumn("part", F.col("traj_id") % 4), "response_len").select("traj_id", "part", "slot"))


def slot_checks(d, keys):
    """The checks of a placement, and that the slots of every part are 0, 1, 2, ... with the lightest row first."""
    d = d.withColumn("w", P.attention_workload("response_len"))
    first = F.min_by("w", "slot") == F.min("w")
    slots = d.groupBy(*keys, "part").agg((F.count_distinct("slot") == F.max("slot") + 1).alias("a"), (F.count(F.lit(1)) == F.max("slot") + 1).alias("b"), first.alias("c"))
    return part_checks(d, "w", keys).join(slots.groupBy(*keys).agg(F.min(F.col("a") & F.col("b") & F.col("c")).alias("slots_fit")), list(keys))


C.add("balance_batch", WB + """SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(4 AS BIGINT) AS parts, CAST(16 AS BIGINT) AS fewest, CAST(16 AS BIGINT) AS most,
  CAST(sum(24576*response_len+response_len*response_len) AS BIGINT) AS total, true AS even, true AS from_zero, CAST(4 AS BIGINT) AS numbers, count(*) AS n_rows, count(*) AS n_ids,
  true AS slots_fit FROM fb GROUP BY batch_id""")(
    lambda spark, sf: slot_checks(P.balance_batch(whole_batches(spark, sf, 64), 4, "response_len"), ["batch_id"]))
C.add("balance_batch_minibatch", WB + """SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(pos%64//32 AS BIGINT) AS mb, CAST(4 AS BIGINT) AS parts, CAST(8 AS BIGINT) AS fewest, CAST(8 AS BIGINT) AS most,
  CAST(sum(24576*response_len+response_len*response_len) AS BIGINT) AS total, true AS even, true AS from_zero, CAST(4 AS BIGINT) AS numbers, count(*) AS n_rows, count(*) AS n_ids
FROM fb GROUP BY ALL""")(
    lambda spark, sf: part_checks(P.balance_batch(
        whole_batches(spark, sf, 64).withColumn("mb", F.expr("traj_id % 64 div 32")), 4, "response_len", minibatch="mb"
    ).withColumn("w", P.attention_workload("response_len")), "w", ["batch_id", "mb"]))
C.add("balance_report", """, r AS (SELECT traj_id, response_len, row_number() OVER (ORDER BY response_len DESC, traj_id)-1 AS r, row_number() OVER (ORDER BY traj_id)-1 AS pos, count(*) OVER () AS n FROM rollouts),
  c AS (SELECT pos//(n//8) AS ch, sum(response_len) AS s FROM r GROUP BY 1), b AS (SELECT CASE WHEN (r//8)%2=0 THEN r%8 ELSE 7-r%8 END AS part, sum(response_len) AS s FROM r GROUP BY 1)
SELECT CAST(min(s) AS BIGINT) AS min, CAST(max(s) AS BIGINT) AS max, CAST(max(s)-min(s) AS BIGINT) AS minmax_diff, (SELECT CAST(min(s) AS BIGINT) FROM b) AS balanced_min,
  (SELECT CAST(max(s) AS BIGINT) FROM b) AS balanced_max, round(sum(s)/8,6)+0e0 AS mean FROM c""")(
    lambda spark, sf: rounded(P.balance_report(P.serpentine_partitions(rollouts(spark, sf), 8, "response_len", "traj_id"), 8, "response_len"),
                              "min", "max", "minmax_diff", "balanced_min", "balanced_max", mean="mean"))
