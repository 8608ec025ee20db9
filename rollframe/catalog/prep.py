"""Checks of sources, formatting, filters, sampling and splitting."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.exprs import r6, rounded
from ..operators import filters as FI
from ..operators import format as M
from ..operators import sampling as S
from ..plans.views import rollouts, table
from ..session import shared_dir
from ..sources import readers as R
from ..sources import writers as WR
from .oracle import CATALOG as C


def docs(spark, sf):
    return table(spark, sf, "documents")


def conv(spark, sf):
    return table(spark, sf, "conversations")


def fresh(spark, name, suffix=""):
    """A new path in the shared folder for a table a check writes and reads back."""
    return f"{shared_dir(spark).rstrip('/')}/rollframe-{uuid.uuid4().hex}/{name}{suffix}"


def text(arr):
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")


# ---------------------------------------------------------------- sources and sinks
@C.add("read_prompts", "SELECT doc_id, text, lang FROM documents UNION ALL SELECT item_id, text, 'json' FROM benchmark")
def _(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("json").alias("lang"))
    path = fresh(spark, "benchmark", ".json")
    WR.write_json_records(b, path)
    d = docs(spark, sf)
    return R.read_prompts(spark, [f"{sf}/documents.parquet", path], d.select("doc_id", "text", "lang").schema)


@C.add("read_sft", "SELECT 'Q '||text AS prompt, CAST(n_chars AS VARCHAR) AS response FROM documents")
def _(spark, sf):
    path = fresh(spark, "sft", ".parquet")
    nested = docs(spark, sf).select(F.struct(
        F.concat(F.lit("Q "), "text").alias("question"), F.col("n_chars").cast("string").alias("answer")).alias("extra_info"))
    WR.write_training_parquet(nested, path)
    return R.read_sft(spark, path, "extra_info", "extra_info", ["question"], ["answer"])


@C.add("read_messages", """SELECT conv_id, count(*) AS n, string_agg(role||':'||length(text), ',' ORDER BY turn) AS turns, CAST(NULL AS VARCHAR) AS tools FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    path = fresh(spark, "chat", ".parquet")
    WR.write_training_parquet(M.rows_to_conversation(conv(spark, sf)), path)
    d = R.read_messages(spark, path)
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string")))
    return d.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(line, ",").alias("turns"), F.col("tools").cast("string").alias("tools"))


PREF = """, pf AS (SELECT conv_id, arg_min(text, turn) FILTER (role='user') AS prompt,
   arg_max(text, length(text)*1000-turn) FILTER (role='assistant') AS chosen, arg_min(text, length(text)*1000+turn) FILTER (role='assistant') AS rejected
   FROM conversations GROUP BY conv_id)
"""


def preferences(spark, sf):
    c = conv(spark, sf)
    on = lambda role, e: F.when(F.col("role") == role, e)
    size = F.length("text") * 1000
    return c.groupBy("conv_id").agg(
        F.min_by("text", on("user", F.col("turn"))).alias("prompt"),
        F.max_by("text", on("assistant", size - F.col("turn"))).alias("chosen"),
        F.min_by("text", on("assistant", size + F.col("turn"))).alias("rejected"))


@C.add("read_preferences", PREF + "SELECT prompt, chosen, rejected FROM pf")
def _(spark, sf):
    path = fresh(spark, "pref", ".parquet")
    WR.write_training_parquet(preferences(spark, sf), path)
    return R.read_preferences(spark, path)


@C.add("write_training_parquet", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, sf):
    path = fresh(spark, "train", ".parquet")
    WR.write_training_parquet(docs(spark, sf), path, 1 << 20)
    return spark.read.parquet(path)


@C.add("write_json_records", "SELECT doc_id, quality, toxic FROM labels")
def _(spark, sf):
    path = fresh(spark, "labels", ".json")
    d = table(spark, sf, "labels")
    WR.write_json_records(d, path)
    return spark.read.schema(d.schema).json(path)


def generations(spark, sf):
    return rollouts(spark, sf).select(
        F.concat(F.lit("Q"), F.col("uid").cast("string")).alias("input"), F.col("pred").alias("output"),
        F.col("data_source").alias("gts"), "score", F.col("param_version").alias("step"), "traj_id")


@C.add("dump_generations", "SELECT 'Q'||uid AS input, pred AS output, data_source AS gts, score, param_version AS step, traj_id FROM rollouts")
def _(spark, sf):
    path = fresh(spark, "dump")
    g = generations(spark, sf)
    WR.dump_generations(g.where("step < 4"), path)
    WR.dump_generations(g.where("step >= 4"), path)
    return R.read_generations(spark, path, g.select("traj_id").schema).select("input", "output", "gts", "score", "step", "traj_id")


C.queries["read_generations"] = C.queries["dump_generations"]
C.sql["read_generations"] = C.sql["dump_generations"]

LINES = """, ln AS (SELECT event_id, CASE WHEN event_id%7=0 THEN 'info ' ELSE '' END||'step:'||event_id||' - actor/loss:'||CAST(round(value) AS BIGINT)
   ||CASE WHEN event_id%5=0 THEN ' - broken' ELSE '' END||' - critic/rewards/mean:'||CASE WHEN event_id%11=0 THEN 'nan?' ELSE CAST(CAST(round(value*10) AS BIGINT) AS VARCHAR) END AS line FROM events)
"""


def lines(spark, sf):
    i = F.col("event_id")
    whole = lambda c: F.round(c).cast("long").cast("string")
    return table(spark, sf, "events").select("event_id", F.concat(
        F.when(i % 7 == 0, "info ").otherwise(""), F.lit("step:"), i.cast("string"), F.lit(" - actor/loss:"), whole(F.col("value")),
        F.when(i % 5 == 0, " - broken").otherwise(""), F.lit(" - critic/rewards/mean:"),
        F.when(i % 11 == 0, "nan?").otherwise(whole(F.col("value") * 10))).alias("line"))


C.add("parse_console_metrics", """SELECT event_id AS step, 'actor/loss' AS name, round(value)+0e0 AS value FROM events WHERE event_id%7<>0
UNION ALL SELECT event_id, 'critic/rewards/mean', round(value*10)+0e0 FROM events WHERE event_id%7<>0 AND event_id%11<>0""")(
    lambda spark, sf: rounded(R.parse_console_metrics(lines(spark, sf)), "step", "name", value="value"))
C.add("best_metric", "SELECT max(round(value*10))+0e0 AS best FROM events WHERE event_id%7<>0 AND event_id%5<>0 AND event_id%11<>0")(
    lambda spark, sf: R.best_metric(lines(spark, sf)).select(r6("best").alias("best")))
C.add("line_metric", """SELECT event_id, CASE WHEN event_id%5=0 OR event_id%11=0 THEN -1e9 ELSE round(value*10)+0e0 END AS value FROM events""")(
    lambda spark, sf: lines(spark, sf).select("event_id", r6(F.greatest(R.line_metric("critic/rewards/mean"), F.lit(-1e9))).alias("value")))


@C.add("step_metrics_sink", "SELECT CAST(dayofmonth(ts) AS BIGINT) AS step, event_type AS name, round(avg(value),6)+0e0 AS value FROM events GROUP BY ALL")
def _(spark, sf):
    m = table(spark, sf, "events").groupBy(F.dayofmonth("ts").cast("long").alias("step"), F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    return rounded(R.read_step_metrics(WR.step_metrics_sink(m)), "step", "name", value="value")


@C.add("flatten_params", """SELECT conv_id, 'messages/list_len' AS key, CAST(count(*) AS VARCHAR) AS value FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, 'messages/'||(row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1)||'/role', role FROM conversations
UNION ALL SELECT conv_id, 'messages/'||(row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1)||'/content', text FROM conversations
UNION ALL SELECT conv_id, 'info/turns', CAST(count(*) AS VARCHAR) FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    d = M.rows_to_conversation(conv(spark, sf)).withColumn("info", F.struct(F.size("messages").alias("turns")))
    return R.flatten_params(d, ["conv_id"])


C.add("attach_embeddings", "SELECT doc_id AS idx, CAST(coalesce(len(embedding),0) AS INTEGER) AS dim, round(coalesce(CAST(embedding[1] AS DOUBLE),0),6)+0e0 AS first FROM documents LEFT JOIN embeddings ON doc_id=vec_id")(
    lambda spark, sf: R.attach_embeddings(
        docs(spark, sf).select(F.col("doc_id").alias("idx")), table(spark, sf, "embeddings").withColumnRenamed("vec_id", "idx")).select(
        "idx", F.size("embedding").alias("dim"), r6(F.coalesce(F.try_element_at("embedding", F.lit(1)).cast("double"), F.lit(0.0))).alias("first")))


# ---------------------------------------------------------------- prompt tables
def source_rows(spark, sf):
    """Documents as raw problem rows, with a label where there is one."""
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    code = F.col("doc_id") % 3 == 0
    return d.select(
        F.col("doc_id").alias("idx"), F.when(code, "code").otherwise("math").alias("kind"),
        F.when(code, "livecodebench").otherwise(F.col("lang")).alias("dataset"), F.col("n_chars").cast("string").alias("answer"),
        F.col("quality").cast("string").alias("elo"),
        F.concat(F.lit("def f(self, x) "), F.col("text")).alias("prompt"), F.concat(F.lit("(self, a) "), F.col("lang")).alias("description"),
        F.when(code, F.concat(F.lit("tests "), F.col("source"))).alias("tests"), F.when(F.col("toxic") == 1, F.lit("be kind")).alias("system"),
        (F.col("doc_id") % 10 / 10.0).alias("achievement_prior"))


SRC = """, sr AS (SELECT doc_id AS idx, doc_id%3=0 AS code, lang, source, text, n_chars, quality, toxic,
   CASE WHEN doc_id%3=0 THEN 'livecodebench' ELSE lang END AS dataset FROM documents LEFT JOIN labels USING (doc_id))
"""
C.add("to_prompt_schema", SRC + """SELECT dataset AS data_source, CASE WHEN toxic=1 THEN 'system' ELSE 'user' END AS role0,
  CASE WHEN code THEN 'def f(x) '||replace(text,'(self, ','(') ELSE 'def f(self, x) '||text END AS question, CASE WHEN code THEN 'code' ELSE 'math' END AS ability,
  CASE WHEN code THEN 'tests '||source ELSE CAST(n_chars AS VARCHAR) END AS truth, CAST(idx AS VARCHAR) AS idx, CASE WHEN code THEN '(a) ' ELSE '(self, a) ' END||lang AS description,
  CAST(quality AS VARCHAR) AS elo, round(idx%10/10e0,6)+0e0 AS prior FROM sr""")(
    lambda spark, sf: M.to_prompt_schema(source_rows(spark, sf), "train").select(
        "data_source", F.col("prompt")[0]["role"].alias("role0"), F.element_at("prompt", -1)["content"].alias("question"), "ability",
        F.col("reward_model.ground_truth").alias("truth"), F.col("extra_info.index").alias("idx"), F.col("extra_info.description").alias("description"),
        F.col("extra_info.elo").alias("elo"), r6("extra_info.achievement_prior").alias("prior")))
C.add("normalize_columns", SRC + """SELECT row_number() OVER (ORDER BY idx)-1 AS idx, CASE WHEN code THEN 'code' ELSE 'math' END AS kind, dataset, CAST(n_chars AS VARCHAR) AS answer,
  coalesce(CAST(quality AS VARCHAR),'-') AS elo, '(self, a) '||lang||' The solution will be evaluated in a '||CASE WHEN code THEN 'code' ELSE 'math' END||' environment.' AS description,
  CASE WHEN code THEN 'tests '||source ELSE '-' END AS tests FROM sr""")(
    lambda spark, sf: M.normalize_columns(source_rows(spark, sf).withColumnRenamed("idx", "doc_id"), "corpus", "doc_id").select(
        "idx", "kind", "dataset", "answer", "elo", "description", "tests"))


def sql_text(t):
    return "'" + t.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"


def template_sql(template, **slots):
    for k, v in slots.items():
        template = template.replace("{" + k + "}", "\x01" + v + "\x01")
    parts = template.split("\x01")
    return "||".join(p if i % 2 else sql_text(p) for i, p in enumerate(parts))


C.add("prompt_template", SRC + f"SELECT idx, CASE WHEN code THEN {template_sql(M.CODE_TEMPLATE, problem='text')} ELSE {template_sql(M.MATH_TEMPLATE, problem='text')} END AS prompt FROM sr")(
    lambda spark, sf: M.prompt_template(source_rows(spark, sf).drop("prompt").join(
        docs(spark, sf).select(F.col("doc_id").alias("idx"), F.col("text").alias("problem")), "idx")).select("idx", "prompt"))
C.add("strip_affixes", f"SELECT doc_id, {template_sql(M.MATH_TEMPLATE, problem='trim(text, chr(32)||chr(10)||chr(9)||chr(13))')} AS content, 'system' AS role0 FROM documents")(
    lambda spark, sf: M.strip_affixes(docs(spark, sf).select("doc_id", F.array(
        M.message("system", F.lit("s")), M.message("user", F.concat(
            F.when(F.col("doc_id") % 2 == 0, M.ANSWER_LINE_PREFIX).otherwise(""), "text",
            F.when(F.col("doc_id") % 3 == 0, M.ANSWER_LINE_SUFFIX).otherwise("")))).alias("prompt"))).select(
        "doc_id", F.element_at("prompt", -1)["content"].alias("content"), F.col("prompt")[0]["role"].alias("role0")))
MT = """, mt AS (SELECT doc_id, CASE WHEN doc_id%10=0 THEN ' '||chr(10) ELSE '  '||text||chr(10) END AS problem,
   CASE WHEN doc_id%7=0 THEN '' WHEN doc_id%2=0 THEN ' \\boxed{'||n_chars||'} ' ELSE CAST(n_chars AS VARCHAR) END AS answer, lang AS solution, source FROM documents)
"""


def math_rows(spark, sf):
    i, n = F.col("doc_id"), F.col("n_chars").cast("string")
    return docs(spark, sf).select(
        "doc_id", F.when(i % 10 == 0, " \n").otherwise(F.concat(F.lit("  "), "text", F.lit("\n"))).alias("problem"),
        F.when(i % 7 == 0, "").when(i % 2 == 0, F.concat(F.lit(" \\boxed{"), n, F.lit("} "))).otherwise(n).alias("answer"),
        F.col("lang").alias("solution"), "source")


C.add("format_math_train", MT + f""", k AS (SELECT *, row_number() OVER (ORDER BY doc_id)-1 AS i FROM mt WHERE doc_id%10<>0 AND doc_id%7<>0)
SELECT 'math' AS data_source, CAST(i AS VARCHAR) AS idx, {template_sql(M.MATH_TEMPLATE, problem="trim(problem, chr(32)||chr(10)||chr(9)||chr(13))")} AS content,
  CASE WHEN doc_id%2=0 THEN regexp_extract(answer,'[0-9]+') ELSE answer END AS truth, solution AS reference, source FROM k""")(
    lambda spark, sf: M.format_math_train(math_rows(spark, sf), "doc_id").select(
        "data_source", F.col("extra_info.index").alias("idx"), F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("truth"),
        F.col("reward_model.reference").alias("reference"), F.col("extra_info.source").alias("source")))
HASHED = "lang||' #### '||CASE doc_id%4 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN '-'||n_chars WHEN 2 THEN '1,'||lpad(CAST(n_chars%1000 AS VARCHAR),3,'0')||'.5' ELSE 'none' END"


def hashed(spark, sf):
    n, i = F.col("n_chars").cast("string"), F.col("doc_id") % 4
    tail = F.when(i == 0, n).when(i == 1, F.concat(F.lit("-"), n)).when(
        i == 2, F.concat(F.lit("1,"), F.lpad((F.col("n_chars") % 1000).cast("string"), 3, "0"), F.lit(".5"))).otherwise("none")
    return docs(spark, sf).select("doc_id", F.col("text").alias("problem"), F.concat("lang", F.lit(" #### "), tail).alias("answer"), "n_chars", "lang")


for _t, _e in (
    ("hash", "CASE doc_id%4 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 2 THEN '1'||lpad(CAST(n_chars%1000 AS VARCHAR),3,'0')||'.5' ELSE '' END"),
    ("plain_hash", "CASE doc_id%4 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 2 THEN '1' ELSE '' END"),
    ("none", HASHED),
):
    C.add(f"format_eval_set_{_t}", f"SELECT 'set' AS data_source, CAST(row_number() OVER (ORDER BY doc_id)-1 AS VARCHAR) AS idx, {_e} AS truth, text AS problem FROM documents")(
        lambda spark, sf, t=_t: M.format_eval_set(hashed(spark, sf), "set", "doc_id", answer_transform=t).select(
            "data_source", F.col("extra_info.index").alias("idx"), F.col("reward_model.ground_truth").alias("truth"), F.col("extra_info.problem").alias("problem")))

MC = """, mc AS (SELECT doc_id, text, lang, source, ['yes '||lang, 'no '||source, 'maybe', 'n'||n_chars] AS opts FROM documents)
"""
C.add("format_mcq_shuffle", MC + """, o AS (SELECT doc_id, text, opts, unnest(opts) AS a FROM mc), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id||'|'||a||'|0'), a) AS i FROM o),
  g AS (SELECT doc_id, any_value(text) AS text, string_agg(chr(CAST(64+i AS INTEGER))||') '||a, ', ' ORDER BY i) AS options, max(CASE WHEN a=opts[1] THEN chr(CAST(64+i AS INTEGER)) END) AS answer FROM r GROUP BY doc_id)
SELECT doc_id, options, answer, """ + template_sql(M.LETTER_TEMPLATE, problem="text", options="options") + " AS prompt FROM g")(
    lambda spark, sf: M.format_mcq_shuffle(docs(spark, sf).withColumns({
        "a0": F.concat(F.lit("yes "), "lang"), "a1": F.concat(F.lit("no "), "source"), "a2": F.lit("maybe"),
        "a3": F.concat(F.lit("n"), F.col("n_chars").cast("string"))}), "doc_id", "text", "a0", ["a1", "a2", "a3"]).select("doc_id", "options", "answer", "prompt"))


def with_options(spark, sf):
    return docs(spark, sf).withColumn("opts", F.array(
        F.concat(F.lit("yes "), "lang"), F.concat(F.lit("no "), "source"), F.lit("maybe"), F.concat(F.lit("n"), F.col("n_chars").cast("string"))))


C.add("format_mcq_options_cot", MC + "SELECT doc_id, " + template_sql(M.SUBJECT_HEADER, subject="lang") + """||chr(10)||'Question:'||chr(10)||text||chr(10)||'Options:'||chr(10)
  ||'A. '||opts[1]||chr(10)||'B. '||opts[2]||chr(10)||'C. '||opts[3]||chr(10)||'D. '||opts[4]||chr(10)||'Answer: Let''s think step by step.' AS prompt FROM mc""")(
    lambda spark, sf: M.format_mcq_options(with_options(spark, sf), "text", "opts", "lang").select("doc_id", "prompt"))
C.add("format_mcq_options_boxed", MC + """SELECT doc_id, text||chr(10)||'Options are:'||chr(10)||'A: '||opts[1]||chr(10)||'B: '||opts[2]||chr(10)||'C: '||opts[3]||chr(10)||'D: '||opts[4]||chr(10)||""" + sql_text(M.BOXED_LETTER_TAIL) + " AS prompt FROM mc")(
    lambda spark, sf: M.format_mcq_options(with_options(spark, sf), "text", "opts", style="boxed").select("doc_id", "prompt"))
C.add("format_labeled_choices", """SELECT doc_id, 'sciknoweval' AS dataset, text||chr(10)||chr(10)||'A: '||lang||chr(10)||'B: '||source||chr(10)||'Please reason step by step.' AS prompt,
  'A' AS answer, text AS description, 'mcq' AS kind, 1500 AS elo FROM documents""")(
    lambda spark, sf: M.format_labeled_choices(docs(spark, sf).select(
        "doc_id", F.col("text").alias("question"), F.struct(F.array(F.lit("A"), F.lit("B")).alias("label"), F.array("lang", "source").alias("text")).alias("choices"),
        F.lit("A").alias("answerKey"))).select("doc_id", "dataset", "prompt", "answer", "description", "kind", "elo"))
C.add("html_problem", """SELECT doc_id, '<html><body><h1>'||lang||'</h1><div>Time limit per test: '||(doc_id%5)||' s</div><h2>Description</h2><div>'||text||'</div><h2>Input Format</h2><div>in '||source||
  '</div><h2>Output Format</h2><div>out</div>'||CASE WHEN doc_id%2=0 THEN '<h2>Interaction</h2><div>talk</div>' ELSE '' END||CASE WHEN doc_id%3=0 THEN '<h2>Note</h2><div>n</div>' ELSE '' END||'</body></html>' AS problem FROM documents""")(
    lambda spark, sf: M.html_problem(docs(spark, sf).withColumns({
        "title": F.col("lang"), "time_limit": F.col("doc_id") % 5, "description": F.col("text"), "input_format": F.concat(F.lit("in "), "source"),
        "output_format": F.lit("out"), "interaction_format": F.when(F.col("doc_id") % 2 == 0, "talk").otherwise(""),
        "note": F.when(F.col("doc_id") % 3 == 0, "n"), "editorial": F.lit(None).cast("string")}), "long").select("doc_id", "problem"))
C.add("tests_to_json", """, tr AS (SELECT traj_id, string_agg('"'||replace(input,chr(10),'\\n')||'"', ',' ORDER BY test_idx) AS i, string_agg('"'||expected||'"', ',' ORDER BY test_idx) AS o FROM test_records GROUP BY traj_id)
SELECT traj_id, '{"inputs":['||i||'],"outputs":['||o||'],"testtype":"'||CASE WHEN traj_id%2=0 THEN 'functional","fn_name":"f' ELSE 'stdin","fn_name":"' END||'","time_limit":2.0}' AS tests FROM tr""")(
    lambda spark, sf: test_sets(spark, sf).select("traj_id", "tests"))


def test_sets(spark, sf):
    from ..plans.views import test_records

    g = test_records(spark, sf).groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("test_idx", "input", F.col("expected").alias("output")))).alias("p"))
    fn = F.when(F.col("traj_id") % 2 == 0, "f").otherwise("")
    return g.withColumn("tests", M.tests_to_json(F.col("p"), M.test_type(fn), fn, M.parse_limit_default(F.lit("2 seconds"), 1)))


C.add("parse_limit_default", "SELECT doc_id, CASE doc_id%4 WHEN 0 THEN 1e0 WHEN 1 THEN n_chars+0e0 WHEN 2 THEN n_chars/2e0 ELSE 1e0 END AS seconds FROM documents")(
    lambda spark, sf: docs(spark, sf).select("doc_id", M.parse_limit_default(
        F.when(F.col("doc_id") % 4 == 0, F.lit("  ")).when(F.col("doc_id") % 4 == 1, F.concat(F.col("n_chars").cast("string"), F.lit(" seconds")))
        .when(F.col("doc_id") % 4 == 2, (F.col("n_chars") / 2).cast("string")), 1).alias("seconds")))
SEPS = ["Input\n", "### Input Format:\n", "-----Examples:-----\n", "Example 1:\n", "text for example: x\n", "``` code\n", "a -----\n", "INPUT / OUTPUT\n"]


def separated(spark, sf):
    sep = F.element_at(F.array(*[F.lit(s) for s in SEPS]), (F.col("doc_id") % len(SEPS) + 1).cast("int"))
    return docs(spark, sf).select("doc_id", F.concat(
        F.lit("About "), F.col("lang"), F.lit(" and "), F.col("source"), F.lit("\n"), F.when(F.col("doc_id") % 5 == 0, "tail -\n").otherwise(""), sep, F.col("text")).alias("problem"))


C.add("problem_description", "SELECT doc_id, 'About '||lang||' and '||source AS description FROM documents")(
    lambda spark, sf: separated(spark, sf).select("doc_id", M.problem_description("problem").alias("description")))
C.add("code_signature", """SELECT doc_id, 'def '||lang||'_fn(self, x):' AS signature, lang||'_fn' AS fn, text||CASE WHEN doc_id%2=0 THEN chr(10)||chr(10)||'Your solution should have the following signature: ```python'||chr(10)||'def '||lang||'_fn(self, x):'||chr(10)||'```' ELSE '' END AS problem FROM documents""")(
    lambda spark, sf: docs(spark, sf).withColumn("starter", F.concat(F.lit("class S:\n  def "), "lang", F.lit("_fn(self, x):\n Input\n rest"))).select(
        "doc_id", M.code_signature("starter").alias("signature"), M.function_name("starter").alias("fn"),
        M.with_signature(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("starter")).otherwise(" ")).alias("problem")))
C.add("docstring_description", "SELECT doc_id, lang||' '||source||chr(10)||'more' AS description FROM documents")(
    lambda spark, sf: docs(spark, sf).select("doc_id", M.docstring_description(F.concat(
        F.lit('import x\n"""module"""\ndef '), "lang", F.lit("(a):\n"), F.when(F.col("doc_id") % 2 == 0, '"""').otherwise("'''"), F.lit(" "), "lang", F.lit(" "), "source",
        F.lit("\nmore\n>>> "), "lang", F.lit("(1)\n"), F.when(F.col("doc_id") % 2 == 0, '"""').otherwise("'''")), F.col("lang")).alias("description")))
C.add("gsm8k_prompt", "SELECT doc_id AS idx, text||' '||" + sql_text(M.HASH_INSTRUCTION) + " AS content, CASE WHEN doc_id%2=0 THEN '-' ELSE '' END||'1'||n_chars AS truth, 'rule' AS style FROM documents")(
    lambda spark, sf: M.gsm8k_prompt(docs(spark, sf).select("doc_id", F.col("text").alias("question"), F.concat(
        F.lit("so #### "), F.when(F.col("doc_id") % 2 == 0, "-").otherwise(""), F.lit("1,"), F.col("n_chars").cast("string")).alias("answer")), "doc_id", "train").select(
        F.col("extra_info.index").alias("idx"), F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("truth"), F.col("reward_model.style").alias("style")))


@C.add("boxed_prompt", "SELECT doc_id AS idx, text||' '||" + sql_text(M.BOXED_INSTRUCTION) + " AS content, CASE WHEN doc_id%2=0 THEN '\\frac{'||n_chars||'}{2}' ELSE CAST(n_chars AS VARCHAR) END AS truth FROM documents")
def _(spark, sf):
    from ..functions.text import extract_last_boxed

    n = F.col("n_chars").cast("string")
    inner = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\\frac{"), n, F.lit("}{2}"))).otherwise(n)
    d = docs(spark, sf).select("doc_id", F.col("text").alias("problem"), F.concat(F.lit("first \\boxed{0}, then \\boxed{"), inner, F.lit("} done")).alias("solution"))
    return M.boxed_prompt(d, "doc_id", "train", extract_last_boxed("solution")).select(
        F.col("extra_info.index").alias("idx"), F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("truth"))


C.add("hellaswag_prompt", """SELECT doc_id AS idx, lang||': a b'||' C'||CASE WHEN doc_id%3=0 THEN '. t' ELSE 'c '||lang END AS query, CAST(doc_id%4 AS INTEGER) AS truth, 'x '||source AS choice0 FROM documents WHERE doc_id%5<>0""")(
    lambda spark, sf: M.hellaswag_prompt(docs(spark, sf).select(
        "doc_id", F.lit("a [x] b").alias("ctx_a"), F.when(F.col("doc_id") % 3 == 0, "c [title]t").otherwise(F.concat(F.lit("cC "), F.upper("lang"))).alias("ctx_b"),
        F.col("lang").alias("activity_label"), F.array(F.concat(F.lit("[m]x  "), "source"), F.lit("y")).alias("endings"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise((F.col("doc_id") % 4).cast("string")).alias("label")), "doc_id", "train").select(
        F.col("extra_info.index").alias("idx"), F.col("prompt")[0]["content"].alias("query"), F.col("reward_model.ground_truth").alias("truth"),
        F.col("reward_model.choices")[0].alias("choice0")))
C.add("preference_to_sft", PREF + "SELECT prompt, chosen AS response FROM pf UNION ALL SELECT prompt, rejected FROM pf")(
    lambda spark, sf: M.preference_to_sft(preferences(spark, sf)))
C.add("preference_rl_prompts", PREF + "SELECT conv_id AS idx, 'hh' AS data_source, prompt AS content, 'alignment' AS ability, chosen AS truth, 'model' AS style FROM pf")(
    lambda spark, sf: M.preference_rl_prompts(preferences(spark, sf), "conv_id", "train", "hh", "chosen").select(
        F.col("extra_info.index").alias("idx"), "data_source", F.col("prompt")[0]["content"].alias("content"), "ability",
        F.col("reward_model.ground_truth").alias("truth"), F.col("reward_model.style").alias("style")))
C.add("qa_prompt_with_tools", "SELECT doc_id AS idx, 'searchR1_'||lang AS data_source, " + sql_text(M.SEARCH_USER_PREFIX) + """||text AS content, CASE WHEN doc_id%2=0 THEN source ELSE lang||',alt' END AS truth,
  'searchR1_'||lang AS tool_source, true AS need_tools FROM documents""")(
    lambda spark, sf: M.qa_prompt_with_tools(docs(spark, sf).select(
        "doc_id", F.col("text").alias("question"), F.col("lang").alias("data_source"), F.lit("qa").alias("ability"),
        F.when(F.col("doc_id") % 2 == 0, F.struct(F.array("source").alias("ground_truth"))).alias("reward_model"),
        F.array(F.col("lang"), F.lit("alt")).alias("golden_answers"), F.lit("m").alias("metadata")), "doc_id", "train").select(
        F.col("extra_info.index").alias("idx"), "data_source", F.col("prompt")[1]["content"].alias("content"),
        text("extra_info.tools_kwargs.search.create_kwargs.ground_truth").alias("truth"),
        F.col("extra_info.tools_kwargs.search.create_kwargs.data_source").alias("tool_source"), F.col("extra_info.need_tools_kwargs").alias("need_tools")))
C.add("add_tool_kwargs", "SELECT doc_id, true AS need_tools, source AS tool_truth, lang AS query, source AS inter_truth, 'tool_agent' AS agent_name, 'train' AS split FROM documents")(
    lambda spark, sf: M.add_tool_kwargs(docs(spark, sf).select(
        "doc_id", "lang", F.struct(F.col("source").alias("ground_truth")).alias("reward_model"), F.struct(F.lit("train").alias("split")).alias("extra_info")),
        "calc_reward", query="lang", agent="tool_agent").select(
        "doc_id", F.col("extra_info.need_tools_kwargs").alias("need_tools"), F.col("extra_info.tools_kwargs.calc_reward.create_kwargs.ground_truth").alias("tool_truth"),
        F.col("extra_info.interaction_kwargs.query").alias("query"), F.col("extra_info.interaction_kwargs.ground_truth").alias("inter_truth"), "agent_name",
        F.col("extra_info.split").alias("split")))
C.add("qa_to_messages", "SELECT doc_id, 'user' AS r0, text||' '||" + sql_text(M.HASH_INSTRUCTION) + " AS c0, 'assistant' AS r1, source AS c1 FROM documents")(
    lambda spark, sf: M.qa_to_messages(docs(spark, sf).select("doc_id", F.col("text").alias("question"), F.col("source").alias("answer"))).select(
        "doc_id", F.col("messages")[0]["role"].alias("r0"), F.col("messages")[0]["content"].alias("c0"), F.col("messages")[1]["role"].alias("r1"), F.col("messages")[1]["content"].alias("c1")))
# the format knows two speakers: whoever isn't the model speaks as a human
C.add("sharegpt_to_messages", "SELECT conv_id, string_agg(CASE WHEN role='assistant' THEN role ELSE 'user' END, ',' ORDER BY turn) AS roles, string_agg(text, '|' ORDER BY turn) AS contents FROM conversations GROUP BY conv_id")(
    lambda spark, sf: M.sharegpt_to_messages(conv(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", F.when(F.col("role") == "assistant", "gpt").otherwise("human").alias("from"), F.col("text").alias("value")))).alias("conversations"))).select(
        "conv_id", F.array_join("messages.role", ",").alias("roles"), F.array_join("messages.content", "|").alias("contents")))
C.add("rows_to_conversation", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, string_agg(text, '|' ORDER BY turn) AS contents FROM conversations GROUP BY conv_id")(
    lambda spark, sf: M.rows_to_conversation(conv(spark, sf)).select(
        "conv_id", F.array_join("messages.role", ",").alias("roles"), F.array_join("messages.content", "|").alias("contents")))
C.add("conversation_to_rows", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS INTEGER) AS turn, role, text AS content FROM conversations")(
    lambda spark, sf: M.conversation_to_rows(M.rows_to_conversation(conv(spark, sf))))
MEDIA = """, cm AS (SELECT conv_id, turn, CASE WHEN turn%2=0 THEN '<image>'||role||'<image><video>'||length(text) ELSE role||'<image>' END AS text FROM conversations),
  sg AS (SELECT conv_id, turn, CAST(unnest(range(len(p))) AS INTEGER) AS seg_no, unnest(p) AS s FROM (SELECT conv_id, turn,
     CASE WHEN turn%2=0 THEN ['<image>', split_part(text,'<image>',2), '<image>', '<video>', split_part(text,'<video>',2)] ELSE [split_part(text,'<image>',1), '<image>'] END AS p FROM cm)),
  tt AS (SELECT conv_id, count(*) FILTER (s='<image>') AS ni, count(*) FILTER (s='<video>') AS nv FROM sg GROUP BY conv_id)
"""


def media(spark, sf):
    c = conv(spark, sf)
    body = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<image>"), "role", F.lit("<image><video>"), F.length("text").cast("string"))).otherwise(F.concat("role", F.lit("<image>")))
    n = c.groupBy("conv_id").agg(F.sum(F.when(F.col("turn") % 2 == 0, 2).otherwise(1)).alias("n_images"), F.sum(F.when(F.col("turn") % 2 == 0, 1).otherwise(0)).alias("n_videos"))
    n = n.withColumn("n_images", F.when(F.col("conv_id") % 10 == 0, F.col("n_images") + 1).otherwise(F.col("n_images")))
    return c.withColumn("text", body).join(n, "conv_id")


C.add("split_media_segments", MEDIA + """SELECT conv_id, turn, seg_no, conv_id%10<>0 AS ok, CASE s WHEN '<image>' THEN 'image' WHEN '<video>' THEN 'video' ELSE 'text' END AS type,
  CASE WHEN s NOT IN ('<image>','<video>') THEN s END AS text, CASE WHEN s IN ('<image>','<video>') THEN count(*) OVER (PARTITION BY conv_id, s ORDER BY turn, seg_no)-1 END AS media_no FROM sg""")(
    lambda spark, sf: M.split_media_segments(media(spark, sf)).select("conv_id", "turn", "seg_no", "ok", "type", "text", "media_no"))
C.add("rl_row_defaults", """SELECT event_id, CASE WHEN event_id%3=0 THEN '0' ELSE CAST(event_id AS VARCHAR) END AS idx, CASE WHEN event_id%3=1 THEN '{"a":1}' ELSE '{}' END AS tools_kwargs, '{}' AS interaction_kwargs,
  event_id%3=2 AS missing_tools FROM events""")(
    lambda spark, sf: M.rl_row_defaults(table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.concat(
        F.lit('{"index":'), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 1, ',"tools_kwargs":{"a":1}').otherwise(""),
        F.lit(',"need_tools_kwargs":true}'))).alias("extra_info"))).select("event_id", F.col("index").alias("idx"), "tools_kwargs", "interaction_kwargs", "missing_tools"))

RT = """, ra AS (SELECT conv_id AS question_id, turn, 'Q'||conv_id AS question, role||turn AS response, CASE WHEN conv_id%4=0 THEN NULL ELSE 'fb'||length(text) END AS feedback FROM conversations)
"""


def attempts(spark, sf):
    return conv(spark, sf).select(
        F.col("conv_id").alias("question_id"), "turn", F.concat(F.lit("Q"), F.col("conv_id").cast("string")).alias("question"),
        F.concat("role", F.col("turn").cast("string")).alias("response"),
        F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("fb"), F.length("text").cast("string"))).alias("feedback"))


_P, _S = sql_text(M.RETRY_PREFIX), sql_text(M.RETRY_SUFFIX)
C.add("multiturn_retry_prompt_feedback", RT + f"""SELECT question_id, any_value(question)||CASE WHEN count(feedback)>0 THEN chr(10)||chr(10)||{_P}||string_agg(feedback, chr(10)||chr(10) ORDER BY turn)||{_S} ELSE '' END AS content FROM ra GROUP BY question_id""")(
    lambda spark, sf: M.multiturn_retry_prompt(attempts(spark, sf), "feedback_only").select("question_id", F.col("messages")[0]["content"].alias("content")))
C.add("multiturn_retry_prompt_attempts", RT + f"""SELECT question_id, 'user:'||any_value(question)||coalesce(string_agg('|assistant:'||response||'|user:'||{_P}||feedback||{_S}, '' ORDER BY turn),'') AS content FROM ra GROUP BY question_id""")(
    lambda spark, sf: M.multiturn_retry_prompt(attempts(spark, sf), "attempt_and_feedback").select(
        "question_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("content")))
C.add("trim_history_to_budget", """, r AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS tail FROM conversations)
SELECT conv_id, turn FROM r WHERE tail<=1500-20""")(
    lambda spark, sf: M.trim_history_to_budget(conv(spark, sf), 1500, F.length("text"), fixed=F.lit(20)).select("conv_id", "turn"))

# ---------------------------------------------------------------- filters
C.add("filter_overlong_prompts", "SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text,'\\s+'), lambda w: w<>''))<=500")(
    lambda spark, sf: FI.filter_overlong_prompts(docs(spark, sf).select("doc_id", F.array(M.message("user", F.col("text"))).alias("prompt")), 500).select("doc_id"))
C.add("filter_overlong_prompts_tokenizer", "SELECT doc_id FROM documents WHERE doc_id%10<>0 AND n_chars<=2000")(
    lambda spark, sf: FI.filter_overlong_prompts(docs(spark, sf), 2000, FI.token_length(list)(
        F.when(F.col("doc_id") % 10 != 0, F.col("text")))).select("doc_id"))
C.add("filter_category", "SELECT doc_id FROM documents WHERE lang IN ('en','de') AND source='src3'")(
    lambda spark, sf: FI.filter_category(docs(spark, sf).select("doc_id", "lang", F.struct("source").alias("details")), lang=["en", "de"], details__source="src3").select("doc_id"))
C.add("filter_date_window", "SELECT event_id FROM events WHERE ts>=TIMESTAMP '2024-01-05 00:00:00' AND ts<TIMESTAMP '2024-01-20 00:00:00'")(
    lambda spark, sf: FI.filter_date_window(table(spark, sf, "events"), "ts", "2024-01-05 00:00:00", "2024-01-20 00:00:00").select("event_id"))
C.add("filter_fenced_solution", "SELECT doc_id FROM documents WHERE doc_id%3=0")(
    lambda spark, sf: FI.filter_fenced_solution(docs(spark, sf).withColumn("s", F.concat(
        F.when(F.col("doc_id") % 3 != 1, "```python\n").otherwise("```\n"), "text", F.when(F.col("doc_id") % 3 != 2, "\n```").otherwise(""))), "s").select("doc_id"))
C.add("assert_nonblank", "SELECT doc_id, lang FROM documents")(lambda spark, sf: FI.assert_nonblank(docs(spark, sf), "lang").select("doc_id", "lang"))
C.add("filter_groups", "SELECT traj_id FROM (SELECT traj_id, min(acc) OVER g<max(acc) OVER g OR count(*) OVER g=1 AS keep FROM rollouts WINDOW g AS (PARTITION BY uid)) WHERE keep")(
    lambda spark, sf: FI.filter_groups(rollouts(spark, sf)).select("traj_id"))
C.add("rollouts_search", "SELECT conv_id, turn FROM conversations WHERE (contains(text,'e') OR contains(role,'e')) AND conv_id=12")(
    lambda spark, sf: FI.rollouts_search(conv(spark, sf).withColumn("request_id", F.concat(F.lit("a-"), F.col("conv_id").cast("string"), F.lit("-b"))),
                                         "e", "a12-b", texts=["text", "role"]).select("conv_id", "turn"))


# ---------------------------------------------------------------- sampling and splitting
def h(key, seed):
    return f"md5({key}||'|{seed}')"


C.add("sample_n", f"SELECT doc_id FROM documents ORDER BY {h('doc_id', 3)}, doc_id LIMIT 100")(
    lambda spark, sf: S.sample_n(docs(spark, sf), "doc_id", 100, True, 3).select("doc_id"))
C.add("sample_n_first", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")(lambda spark, sf: S.sample_n(docs(spark, sf), "doc_id", 100).select("doc_id"))
UNIT = "CAST('0x'||substr({},1,8) AS BIGINT)/4294967296e0"
C.add("split_by_ratio", f"SELECT doc_id, CASE WHEN {UNIT.format(h('doc_id', 42))}<0.1 THEN 'test' ELSE 'train' END AS split FROM documents")(
    lambda spark, sf: S.split_by_ratio(docs(spark, sf), "doc_id", 0.1).select("doc_id", "split"))
C.add("split_by_ratio_exact", f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {h('doc_id', 42)}, doc_id)<=ceil(0.1*count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM documents")(
    lambda spark, sf: S.split_by_ratio(docs(spark, sf), "doc_id", 0.1, exact=True).select("doc_id", "split"))
C.add("split_head_tail", """, p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, 'train' AS split FROM p WHERE i<=round(n*0.75) UNION ALL SELECT doc_id, 'test' FROM p WHERE i>n-round(n*0.25)""")(
    lambda spark, sf: S.split_head_tail(docs(spark, sf), "doc_id").select("doc_id", "split"))
C.add("split_holdout_groups", """, g AS (SELECT lang FROM documents GROUP BY lang ORDER BY md5(lang||'|0'), lang LIMIT 1),
  r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(lang||'|'||doc_id||'|0'), doc_id) AS rk, lang=(SELECT lang FROM g) AS ood FROM documents)
SELECT doc_id, lang, CASE WHEN ood THEN 'test_out_of_distribution' WHEN rk<=40 THEN 'train' ELSE 'test_in_distribution' END AS split FROM r WHERE (ood AND rk<=20) OR (NOT ood AND rk<=50)""")(
    lambda spark, sf: S.split_holdout_groups(docs(spark, sf), "lang", "doc_id").select("doc_id", "lang", "split"))
STS = """, tk AS (SELECT traj_id, test_idx, input, expected, row_number() OVER (PARTITION BY traj_id ORDER BY md5(traj_id||'|'||test_idx||'|0'), test_idx) AS rk, count(*) OVER (PARTITION BY traj_id) AS n FROM test_records),
  kp AS (SELECT * FROM tk WHERE rk<=greatest(1, floor(n*0.5)))
"""
C.add("sample_tests", STS + """SELECT traj_id, string_agg(expected, ',' ORDER BY test_idx) AS outputs, CAST(any_value(n) AS INTEGER) AS n_tests, CAST(count(*) AS INTEGER) AS n_kept FROM kp GROUP BY traj_id""")(
    lambda spark, sf: S.sample_tests(test_sets(spark, sf), "traj_id").select(
        "traj_id", F.array_join(F.from_json("tests", "outputs array<string>")["outputs"], ",").alias("outputs"), "n_tests", "n_kept"))
C.add("test_counts", STS + ", c AS (SELECT traj_id, any_value(n) AS n, count(*) AS k FROM kp GROUP BY traj_id) SELECT round(avg(n),6)+0e0 AS mean_tests, round(avg(k),6)+0e0 AS mean_kept FROM c")(
    lambda spark, sf: S.test_counts(S.sample_tests(test_sets(spark, sf), "traj_id")).select(r6("mean_tests").alias("mean_tests"), r6("mean_kept").alias("mean_kept")))
C.add("slice_range", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 150 OFFSET 40")(lambda spark, sf: S.slice_range(docs(spark, sf), "doc_id", 40, 150).select("doc_id"))
C.add("split_equal", "SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id)-1)/(count(*) OVER ()/5)) AS BIGINT) AS part FROM documents")(
    lambda spark, sf: S.split_equal(docs(spark, sf), "doc_id", 5, uneven=True).select("doc_id", "part"))
C.add("shard", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id)-1)%4 AS shard FROM documents")(lambda spark, sf: S.shard(docs(spark, sf), "doc_id", 4).select("doc_id", "shard"))


@C.add("split_singletons", """, c AS (SELECT conv_id AS question_id, turn, unnest([0,1,2,3]) AS copy FROM conversations)
SELECT question_id, turn, CAST(copy AS INTEGER) AS copy, 'train' AS split FROM c UNION ALL SELECT conv_id, turn, 0, 'test' FROM conversations""")
def _(spark, sf):
    path = fresh(spark, "single")
    d = conv(spark, sf).select(F.col("conv_id").alias("question_id"), "turn")
    WR.write_singletons(d, path)
    back = R.read_singletons(spark, path, "question_id bigint, turn bigint, copy int, split string")
    return back.select("question_id", "turn", "copy", "split")


C.add("epoch_order", """, e AS (SELECT doc_id, CAST(unnest([0,1]) AS INTEGER) AS epoch, (SELECT count(*) FROM documents) AS n FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY md5(doc_id||'|'||epoch||'|5'), doc_id)-1 AS i FROM e)
SELECT doc_id, epoch, CAST(i//64 AS BIGINT) AS batch_id, i%64 AS slot FROM r WHERE i//64<n//64""")(
    lambda spark, sf: S.epoch_order(docs(spark, sf), "doc_id", 64, 2, 5).select("doc_id", "epoch", "batch_id", "slot"))
C.add("curriculum_weights", """, p AS (SELECT c_custkey AS uid, avg(score) AS r FROM customer LEFT JOIN rollouts ON uid=c_custkey GROUP BY 1), q AS (SELECT uid, r, abs(coalesce(r,0.5)-0.5) AS d FROM p)
SELECT uid, round(r,6)+0e0 AS success_rate, row_number() OVER (ORDER BY d, uid) AS place FROM q""")(
    lambda spark, sf: rounded(S.curriculum_weights(table(spark, sf, "customer").select(F.col("c_custkey").alias("uid")), rollouts(spark, sf)), "uid", "place", success_rate="success_rate"))
for _m, _w in (("pow", "pow(abs(score),2)"), ("max_min", "CASE WHEN score IN (0,1) THEN 1e0 ELSE 0e0 END"), ("max_random", "CASE WHEN score=1 THEN 0.4e0 ELSE 0.1e0 END")):
    C.add(f"resample_by_score_{_m}", f""", w AS (SELECT traj_id, greatest({_w}+1e-8,1e-8) AS w FROM rollouts), c AS (SELECT traj_id, sum(w) OVER (ORDER BY traj_id) AS hi, w FROM w),
      d AS (SELECT traj_id AS draw, (CAST('0x'||substr({h('traj_id', 0)},1,13) AS BIGINT)+0.5e0)/4503599627370496e0*(SELECT max(hi) FROM c) AS at FROM rollouts)
    SELECT draw, c.traj_id FROM d ASOF JOIN c ON d.at < c.hi""")(
        lambda spark, sf, m=_m: S.resample_by_score(rollouts(spark, sf), method=m).select("draw", "traj_id"))
C.add("sample_for_review", f"SELECT doc_id FROM documents ORDER BY md5(text||'|'||doc_id||'|42'), doc_id LIMIT 25")(
    lambda spark, sf: S.sample_for_review(docs(spark, sf), "text", "doc_id", 25).select("doc_id"))
C.add("sort_by_score", "SELECT traj_id, round(coalesce(score,0),6)+0e0 AS sort_score FROM rollouts WHERE param_version=3")(
    lambda spark, sf: rounded(S.sort_by_score(rollouts(spark, sf).withColumn("step", F.col("param_version")), 3), "traj_id", sort_score="sort_score"))
C.add("append_generated", "SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id+100000, 'new' FROM documents WHERE n_chars<=300")(
    lambda spark, sf: S.append_generated(docs(spark, sf).select("doc_id", "lang"), docs(spark, sf).select(
        (F.col("doc_id") + 100000).alias("doc_id"), F.lit("new").alias("lang"), "n_chars"), 300, F.col("n_chars")).select("doc_id", "lang"))
