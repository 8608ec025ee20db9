"""Checks of extraction, scoring, routing, code results and passages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.exprs import r6, rounded
from ..operators import retrieval as R
from ..operators import scoring as S
from ..operators.demos import strip_thinking
from ..plans.views import rollouts, table, test_records
from ..session import shared_dir
from .oracle import CATALOG as C


def docs(spark, sf):
    return table(spark, sf, "documents")


def res(df, *keep):
    r = F.col("result")
    return df.select(*keep, r6(r["score"]).alias("score"), r6(r["acc"]).alias("acc"), r["pred"].alias("pred"), r["incorrect_format"].alias("incorrect_format"), r["feedback"].alias("feedback"))


def sc(df, *keep):
    r = F.col("result")
    return df.select(*keep, r6(r["score"]).alias("score"), r["pred"].alias("pred"))


def pick(n, *values):
    """One of the values by ``doc_id`` modulo their number."""
    return F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (F.col("doc_id") % n + 1).cast("int"))


# ---------------------------------------------------------------- hash answers
HASH = """, ha AS (SELECT doc_id, n_chars, text||CASE doc_id%5 WHEN 0 THEN ' #### '||n_chars WHEN 1 THEN ' #### 7 #### '||n_chars||',' WHEN 2 THEN ' #### '||(n_chars+1)
   WHEN 3 THEN ' answer '||n_chars||' ok.' ELSE ' #### '||n_chars||repeat('x',400) END AS resp FROM documents)
"""


def hash_rows(spark, sf):
    n = F.col("n_chars").cast("string")
    end = pick(5, F.concat(F.lit(" #### "), n), F.concat(F.lit(" #### 7 #### "), n, F.lit(",")), F.concat(F.lit(" #### "), (F.col("n_chars") + 1).cast("string")),
               F.concat(F.lit(" answer "), n, F.lit(" ok.")), F.concat(F.lit(" #### "), n, F.repeat(F.lit("x"), F.lit(400))))
    return docs(spark, sf).select("doc_id", F.concat("text", end).alias("resp"), n.alias("truth"))


STRICT = "CASE WHEN doc_id%5 IN (0,1) THEN CAST(n_chars AS VARCHAR) WHEN doc_id%5=2 THEN CAST(n_chars+1 AS VARCHAR) END"
C.add("extract_hash_answer", HASH + f"SELECT doc_id, {STRICT} AS answer FROM ha")(
    lambda spark, sf: hash_rows(spark, sf).select("doc_id", X.extract_hash_answer("resp").alias("answer")))
C.add("extract_hash_answer_flexible", HASH + """, f AS (SELECT doc_id, regexp_extract_all(right(resp,300), '(-?[0-9.,]+)', 1) AS a FROM ha)
SELECT doc_id, coalesce(list_filter(a, lambda x: x<>'' AND x<>'.')[-1], a[1]) AS answer FROM f""")(
    lambda spark, sf: hash_rows(spark, sf).select("doc_id", X.extract_hash_answer("resp", "flexible").alias("answer")))
C.add("score_hash_answer", HASH + f"SELECT doc_id, CASE WHEN doc_id%5 IN (0,1) THEN 1e0 WHEN doc_id%5=2 THEN 0.1e0 ELSE 0e0 END AS score, {STRICT} AS pred FROM ha")(
    lambda spark, sf: sc(hash_rows(spark, sf).withColumn("result", S.score_hash_answer("resp", "truth", format_score=0.1)), "doc_id"))


# ---------------------------------------------------------------- boxed answers
def boxed_rows(spark, sf):
    n = F.col("n_chars").cast("string")
    inner = pick(4, n, F.concat(F.lit("\\frac{"), n, F.lit("}{2}")), F.concat(F.lit(" "), n), F.concat(n, F.lit("!")))
    end = F.when(F.col("doc_id") % 9 == 0, "no box").when(F.col("doc_id") % 9 == 1, "\\boxed{open").otherwise(F.concat(F.lit("\\boxed{"), inner, F.lit("}.")))
    return docs(spark, sf).select("doc_id", F.concat("text", F.lit(" \\boxed{0} "), end).alias("resp"), n.alias("truth"), "n_chars")


BOX = """, bx AS (SELECT doc_id, n_chars, CASE WHEN doc_id%9=0 THEN '0' WHEN doc_id%9=1 THEN NULL ELSE CASE doc_id%4 WHEN 0 THEN ''||n_chars WHEN 1 THEN '\\frac{'||n_chars||'}{2}' WHEN 2 THEN ' '||n_chars ELSE n_chars||'!' END END AS a FROM documents)
"""
C.add("extract_last_boxed", BOX + "SELECT doc_id, a AS answer FROM bx")(
    lambda spark, sf: boxed_rows(spark, sf).select("doc_id", X.extract_last_boxed("resp").alias("answer")))
C.add("extract_last_boxed_fallbacks", "SELECT doc_id, CASE doc_id%3 WHEN 0 THEN n_chars||' and ' WHEN 1 THEN '{'||n_chars||'}' ELSE CAST(n_chars AS VARCHAR) END AS answer FROM documents")(
    lambda spark, sf: docs(spark, sf).select("doc_id", X.extract_last_boxed(F.concat("text", pick(
        3, F.concat(F.lit(" $\\boxed "), F.col("n_chars").cast("string"), F.lit(" and $ x")), F.concat(F.lit(" \\fbox{{"), F.col("n_chars").cast("string"), F.lit("}}")),
        F.concat(F.lit(" \\boxed{"), F.col("n_chars").cast("string"), F.lit("}")))), True).alias("answer")))
C.add("score_math_boxed", BOX + "SELECT doc_id, CASE WHEN trim(a)=CAST(n_chars AS VARCHAR) THEN 1e0 ELSE 0e0 END AS score, a AS pred FROM bx")(
    lambda spark, sf: sc(boxed_rows(spark, sf).withColumn("result", S.score_math_boxed("resp", "truth")), "doc_id"))
# fixed values: pairs the normal form makes equal, and one it does not
LATEX_PAIRS = [
    ("\\frac12", "\\frac{1}{2}"), ("\\dfrac{3}{4}", "\\tfrac{3}{4}"), ("0.5", "\\frac{1}{2}"), ("3/4", "\\frac{3}{4}"), ("\\sqrt3", "\\sqrt{3}"),
    ("x=5", "5"), (".25", "0.25"), ("10\\%", "10"), ("90^\\circ", "90"), ("7\\text{ cm}", "7"), ("\\left(1,2\\right)", "(1,2)"), ("\\frac1{72}", "\\frac{1}{72}"),
    ("2", "3"),
]
C.add("latex_equal", "SELECT doc_id, doc_id%13<>12 AS equal FROM documents")(
    lambda spark, sf: docs(spark, sf).select("doc_id", X.latex_equal(pick(13, *[a for a, _ in LATEX_PAIRS]), pick(13, *[b for _, b in LATEX_PAIRS])).alias("equal")))
C.add("latex_equal_texts", "SELECT doc_id, doc_id%4<>1 AS equal FROM documents")(
    lambda spark, sf: docs(spark, sf).select("doc_id", X.latex_equal(
        pick(4, F.col("text"), F.col("text"), F.concat(F.lit("\\left("), "text", F.lit("\\right)")), F.concat(F.lit("\\dfrac{1}{2}"), "text")),
        pick(4, F.concat("text", F.lit("\\!")), F.concat("text", F.lit("x")), F.concat(F.lit("("), "text", F.lit(")")), F.concat(F.lit("\\tfrac{1}{2}\n"), "text"))).alias("equal")))


def minerva_rows(spark, sf):
    n = F.col("n_chars").cast("string")
    end = pick(5, F.concat(F.lit("\nAnswer: $"), n, F.lit("$")), F.concat(F.lit("\nanswer :\\text{"), n, F.lit("} units")), F.concat(F.lit("\nAnswer: x = "), n, F.lit("\\%")),
               F.lit(" none"), F.concat(F.lit("\nAnswer: 1\nAnswer: "), n))
    return docs(spark, sf).select("doc_id", F.concat("text", end).alias("resp"), n.alias("truth"))


C.add("score_math_minerva", """SELECT doc_id, CASE WHEN doc_id%5 IN (0,1,4) THEN 1e0 ELSE -1e0 END AS score, CASE doc_id%5 WHEN 2 THEN n_chars||'\\%' WHEN 3 THEN '[INVALID]' ELSE CAST(n_chars AS VARCHAR) END AS pred FROM documents""")(
    lambda spark, sf: sc(minerva_rows(spark, sf).withColumn("result", S.score_math_minerva("resp", "truth")), "doc_id"))
C.add("score_math_minerva_strict", BOX + "SELECT doc_id, CASE WHEN a=CAST(n_chars AS VARCHAR) THEN 1e0 ELSE -1e0 END AS score, a AS pred FROM bx")(
    lambda spark, sf: sc(boxed_rows(spark, sf).withColumn("result", S.score_math_minerva("resp", "truth", True)), "doc_id"))
C.add("score_math_feedback", BOX + """SELECT doc_id, CASE WHEN a=CAST(n_chars AS VARCHAR) THEN 1e0 ELSE 0e0 END AS score, CASE WHEN a=CAST(n_chars AS VARCHAR) THEN 1e0 ELSE 0e0 END AS acc, coalesce(a,'') AS pred,
  CASE WHEN a IS NULL THEN 1 ELSE 0 END AS incorrect_format, CASE WHEN doc_id%6=0 THEN 'Your response was truncated because it exceeded the maximum length.'
  WHEN a IS NULL THEN 'Your answer had the wrong format. The solution must be given in the format: \\boxed{your_answer}.' WHEN a<>CAST(n_chars AS VARCHAR) THEN 'Your answer is incorrect. The correct answer is '||n_chars||'.' ELSE '' END AS feedback FROM bx""")(
    lambda spark, sf: res(boxed_rows(spark, sf).withColumn("result", S.score_math_feedback(
        "resp", "truth", F.col("doc_id") % 6 == 0, correctness_feedback=True)), "doc_id"))

# ---------------------------------------------------------------- question answering
QA = """, qa AS (SELECT doc_id, lang, CASE doc_id%6 WHEN 0 THEN ' The '||upper(lang)||'!' WHEN 1 THEN 'x '||lang||' y' WHEN 2 THEN NULL WHEN 3 THEN 'an  "'||lang||'"' WHEN 4 THEN lang ELSE 'other' END AS a FROM documents)
"""


def qa_rows(spark, sf):
    a = pick(6, F.concat(F.lit(" The "), F.upper("lang"), F.lit("!")), F.concat(F.lit("x "), "lang", F.lit(" y")), F.lit(""), F.concat(F.lit('an  "'), "lang", F.lit('"')), F.col("lang"), F.lit("other"))
    tagged = F.concat(F.lit("<answer>z</answer> "), F.when(F.col("doc_id") % 6 == 4, F.repeat(F.lit("<answer>z</answer>"), F.lit(11))).otherwise(""), F.lit("<answer>"), a, F.lit("</answer> end"))
    return docs(spark, sf).select("doc_id", F.concat("text", F.when(F.col("doc_id") % 6 == 2, F.lit("<answer>open")).otherwise(tagged)).alias("resp"),
                                  F.array(F.lit("A Zebra"), F.col("lang")).alias("golden"))


C.add("score_qa_em", QA + "SELECT doc_id, CASE doc_id%6 WHEN 0 THEN 1e0 WHEN 3 THEN 1e0 WHEN 4 THEN 0.25e0 WHEN 2 THEN 0e0 ELSE 0.1e0 END AS score, trim(a) AS pred FROM qa")(
    lambda spark, sf: sc(qa_rows(spark, sf).withColumn("result", S.score_qa_em("resp", "golden", format_score=0.1)), "doc_id"))
C.add("score_qa_subem", QA + "SELECT doc_id, CASE WHEN doc_id%6 IN (0,1,3,4) THEN 1e0 WHEN doc_id%6=2 THEN 0e0 ELSE 0.1e0 END AS score, trim(a) AS pred FROM qa")(
    lambda spark, sf: sc(qa_rows(spark, sf).withColumn("result", S.score_qa_subem("resp", "golden", format_score=0.1)), "doc_id"))


# ---------------------------------------------------------------- multiple choice
def letter():
    return F.char(F.lit(65) + F.col("doc_id") % 4)


L = "chr(CAST(65+doc_id%4 AS INTEGER))"
C.add("score_mcq_xml", f"""SELECT doc_id, CASE WHEN doc_id%3<2 THEN 1e0 ELSE 0e0 END AS score, CASE WHEN doc_id%3<2 THEN 1e0 ELSE 0e0 END AS acc, CASE WHEN doc_id%3<2 THEN {L} ELSE 'E' END AS pred,
  CASE WHEN doc_id%3=0 THEN 0 ELSE 1 END AS incorrect_format, '' AS feedback FROM documents""")(
    lambda spark, sf: res(docs(spark, sf).withColumn("result", S.score_mcq_xml(F.concat("text", F.lit("<answer>q</answer>"), pick(
        3, F.concat(F.lit("<answer>\n"), letter(), F.lit("\n</answer>")), F.concat(F.lit("<answer> "), letter(), F.lit("</answer> bye")), F.lit("<answer>E</answer>"))), letter())), "doc_id"))
ASCII_WORDS = "regexp_replace(upper(text),'[À-ÖØ-Þß-öø-ÿ]','X','g')"
C.add("score_mcq_letter", f""", m AS (SELECT doc_id, CASE WHEN doc_id%4=3 THEN NULL ELSE regexp_extract_all({ASCII_WORDS}||' SO '||CASE WHEN doc_id%4=0 THEN 'B.' ELSE {L} END, '\\b(A|B|C|D)\\b', 1)[-1] END AS l FROM documents)
SELECT doc_id, CASE WHEN doc_id%4=3 THEN 0e0 WHEN l={L} THEN 1e0 ELSE 0e0 END AS score, CASE WHEN doc_id%4=3 THEN regexp_replace(regexp_replace(translate(text,'ABCDabcd','EEEEeeee')||' .maybe..','^\\s+',''),'^\\.+','') ELSE l END AS pred FROM m JOIN documents USING (doc_id)""")(
    lambda spark, sf: sc(docs(spark, sf).withColumn("result", S.score_mcq_letter(F.when(F.col("doc_id") % 4 == 3, F.concat(F.translate("text", "ABCDabcd", "EEEEeeee"), F.lit(" .maybe../"))).otherwise(
        F.concat("text", F.lit(" so "), F.when(F.col("doc_id") % 4 == 0, "b.").otherwise(letter()))), letter())), "doc_id"))
C.add("score_mcq_cascade", f"""SELECT doc_id, CASE WHEN doc_id%4=3 THEN 0e0 ELSE 1e0 END AS score, CASE WHEN doc_id%4=3 THEN 'J' ELSE {L} END AS pred, CASE WHEN doc_id%4=3 THEN 1 ELSE 0 END AS is_j FROM documents""")(
    lambda spark, sf: sc(docs(spark, sf).withColumn("result", S.score_mcq_cascade(pick(
        4, F.concat("text", F.lit("\nThe Answer is ("), letter(), F.lit(") or Answer: J")), F.concat("text", F.lit("\nanswer:  "), letter(), F.lit(" K")),
        F.concat("text", F.lit(" so "), letter(), F.lit(" z")), F.concat("text", F.lit("\nJ is it"))), letter())), "doc_id").withColumn("is_j", F.when(F.col("pred") == "J", 1).otherwise(0)))


# ---------------------------------------------------------------- tools, code, formats
def tool_rows(spark, sf):
    q = F.concat(F.lit('{"q": "'), "lang", F.lit('", "n": "1"}'))
    body = F.concat(F.lit("Action: search\nAction Input: "), q, F.lit("\nAction: "), pick(3, "look", "look", "stop"), F.lit("\nAction Input: "),
                    pick(4, F.lit('{"n": "2"}'), F.lit('{"n": 2'), F.lit("{'n': '2'}"), F.lit('{"n": "2"}')))
    truth = F.concat(F.lit('[{"Action":"look","Action_Input":"{\\"q\\": \\"'), "lang", F.lit('\\", \\"n\\": \\"1\\"}"},{"Action":"search","Action_Input":"{\\"n\\": \\"2\\"}"}]'))
    return docs(spark, sf).select("doc_id", F.concat("text", F.lit("\n"), body).alias("resp"), F.when(F.col("doc_id") % 10 == 9, "oops").otherwise(truth).alias("truth"))


C.add("score_tooluse", """, t AS (SELECT doc_id, lang, doc_id%3<>2 AS act, doc_id%4 IN (0,3) AS inp, doc_id%10=9 AS bad, CASE WHEN doc_id%3=2 THEN 'stop' ELSE 'look' END AS a2, CASE WHEN doc_id%4 IN (0,3) THEN '2' ELSE '1' END AS n FROM documents)
SELECT doc_id, CASE WHEN act AND inp AND NOT bad THEN 1e0 ELSE 0e0 END AS score, CASE WHEN act AND inp AND NOT bad THEN 1e0 ELSE 0e0 END AS acc,
  CASE WHEN bad THEN '' ELSE 'Actions: [''search'', '''||a2||'''], Inputs: {''n'': '''||n||''', ''q'': '''||lang||'''}' END AS pred, CASE WHEN bad THEN 1 ELSE 0 END AS incorrect_format,
  CASE WHEN bad THEN 'Failed to parse ground truth JSON' ELSE concat_ws('; ', CASE WHEN NOT act THEN 'Actions mismatch: predicted [''search'', ''stop''], expected [''look'', ''search'']' END,
   CASE WHEN NOT inp THEN 'Action inputs mismatch: predicted {''n'': ''1'', ''q'': '''||lang||'''}, expected {''n'': ''2'', ''q'': '''||lang||'''}' END) END AS feedback FROM t""")(
    lambda spark, sf: res(tool_rows(spark, sf).withColumn("result", S.score_tooluse("resp", "truth")), "doc_id"))


def typed_rows(spark, sf):
    """Tool inputs with numbers, truth values and nested objects: every sixth of the rows differs in another way."""
    n = F.col("n_chars").cast("string")
    gave = pick(6, F.concat(F.lit('{"n": '), n, F.lit(', "on": true}')), F.concat(F.lit('{"on": true, "n": '), n, F.lit(".0}")), F.concat(F.lit('{"n": "'), n, F.lit('", "on": true}')),
                F.concat(F.lit('{"n": '), n, F.lit(', "on": 1}')), F.concat(F.lit('{"n": '), n, F.lit(', "on": "true"}')), F.concat(F.lit('{"n": -'), n, F.lit(', "on": true}')))
    truth = F.concat(F.lit('[{"Action":"look","Action_Input":{"on": true, "n": '), n, F.lit("}}]"))
    nested = F.concat(F.lit('[{"Action":"look","Action_Input":"{\\"n\\": '), n, F.lit(', \\"on\\": true, \\"deep\\": {\\"b\\": [1, 2], \\"a\\": null}}"}]'))
    return docs(spark, sf).select(
        "doc_id", F.concat("text", F.lit("\nAction: look\nAction Input: "), gave).alias("resp"), F.when(F.col("doc_id") % 12 == 7, nested).otherwise(truth).alias("truth")
    )


C.add("score_tooluse_typed", """SELECT doc_id, CASE WHEN doc_id%6 IN (0,1,3) AND doc_id%12<>7 THEN 1e0 ELSE 0e0 END AS score,
  'Actions: [''look''], Inputs: {''n'': '||CASE doc_id%6 WHEN 2 THEN ''''||n_chars||'''' WHEN 5 THEN '-'||n_chars ELSE CAST(n_chars AS VARCHAR) END
  ||', ''on'': '||CASE doc_id%6 WHEN 3 THEN '1' WHEN 4 THEN '''true''' ELSE 'True' END||'}' AS pred FROM documents""")(
    lambda spark, sf: sc(typed_rows(spark, sf).withColumn("result", S.score_tooluse("resp", "truth")), "doc_id"))
C.add("extract_code_block", "SELECT doc_id, CASE WHEN doc_id%3=0 THEN NULL WHEN doc_id%3=1 THEN 'longer '||lang||chr(10) ELSE 'aa'||chr(10) END AS code FROM documents")(
    lambda spark, sf: docs(spark, sf).select("doc_id", X.extract_code_block(F.concat("text", pick(
        3, F.lit(" ```py no"), F.concat(F.lit("\n```python\nx\n```\nand\n```\nlonger "), "lang", F.lit("\n``` ```")), F.lit("\n```\naa\n```\n```py\nbb\n```")))).alias("code")))
C.add("score_format_think", """SELECT doc_id, CASE doc_id%3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.9e0 ELSE 0.1e0 END AS score, CASE WHEN doc_id%3=2 THEN '0' ELSE CAST(n_chars AS VARCHAR) END AS pred FROM documents""")(
    lambda spark, sf: sc(docs(spark, sf).withColumn("result", S.score_format_think(F.concat(
        F.when(F.col("doc_id") % 3 == 1, "").otherwise("<think>"), "text", F.lit("</think> so \\boxed{"),
        F.when(F.col("doc_id") % 3 == 2, "0").otherwise(F.col("n_chars").cast("string")), F.lit("} end")), F.col("n_chars").cast("string"))), "doc_id"))
C.add("extract_tool_calls", """SELECT doc_id, text||'  tail' AS content, CASE WHEN doc_id%3=0 THEN 2 ELSE 1 END AS n, CASE WHEN doc_id%3=0 THEN 'search|x' ELSE 'search' END AS names,
  '{"q":"'||lang||'"}'||CASE WHEN doc_id%3=0 THEN '|{}' ELSE '' END AS arguments FROM documents""")(
    lambda spark, sf: docs(spark, sf).select("doc_id", X.extract_tool_calls(F.concat(
        "text", F.lit(' <tool_call>{"name":"search","arguments":{"q":"'), "lang", F.lit('"}}</tool_call>'),
        F.when(F.col("doc_id") % 3 == 0, '<tool_call>{"name":"x","arguments":{}}</tool_call>').otherwise("<tool_call>{bad}</tool_call>"), F.lit(" tail"))).alias("c")).select(
        "doc_id", F.col("c.content").alias("content"), F.size("c.calls").alias("n"), F.array_join("c.calls.name", "|").alias("names"), F.array_join("c.calls.arguments", "|").alias("arguments")))
C.add("extract_tool_calls_channel", """SELECT doc_id, text||' tail' AS content, 1 AS n, 'search' AS name, lang AS arguments FROM documents""")(
    lambda spark, sf: docs(spark, sf).select("doc_id", X.extract_tool_calls(F.concat(
        "text", F.lit("<|channel|>analysis<|message|>think<|start|>assistant<|channel|>commentary to=functions.no <|constrain|>json<|message|>{}<|call|><|end|>"),
        F.lit("<|start|>assistant<|channel|>commentary to=functions.search <|constrain|>json<|message|>"), "lang", F.lit("<|call|> tail")), "channel").alias("c")).select(
        "doc_id", F.col("c.content").alias("content"), F.size("c.calls").alias("n"), F.col("c.calls")[0]["name"].alias("name"), F.col("c.calls")[0]["arguments"].alias("arguments")))
C.add("strip_thinking", "SELECT doc_id, 'a '||text||'b' AS text FROM documents")(
    lambda spark, sf: docs(spark, sf).select("doc_id", strip_thinking(F.concat(
        F.lit("<think>x\ny</think> \na "), "text", F.lit("<think>z</think> b"))).alias("text")))
for _s, _e in (("left", "text[1:100]||'...(truncated)'"), ("right", "'(truncated)...'||right(text,100)"), ("middle", "text[1:50]||'...(truncated)...'||right(text,50)")):
    C.add(f"truncate_text_{_s}", f"SELECT doc_id, CASE WHEN length(text)>100 THEN {_e} ELSE text END AS text FROM documents")(
        lambda spark, sf, s=_s: docs(spark, sf).select("doc_id", X.truncate_text("text", 100, s).alias("text")))


# ---------------------------------------------------------------- code results
C.add("code_test_results", """SELECT traj_id, round(avg(CASE WHEN passed THEN 1 ELSE 0 END),6)+0e0 AS acc, count(*) AS n_tests, max(CASE WHEN NOT passed AND contains(actual,'Error: ') THEN 1 ELSE 0 END) AS error_in_test_cases,
  max(CASE WHEN NOT passed AND actual='Time out' THEN 1 ELSE 0 END) AS timed_out, CASE WHEN bool_and(passed) THEN 1e0 ELSE 0e0 END AS score FROM test_records GROUP BY traj_id""")(
    lambda spark, sf: rounded(S.code_test_results(test_records(spark, sf)), "traj_id", "n_tests", "error_in_test_cases", "timed_out", acc="acc", score="score"))
C.add("code_test_results_dense", """SELECT traj_id, round(avg(CASE WHEN passed THEN 1 ELSE 0 END),6)+0e0 AS score, CASE WHEN traj_id%2=0 THEN 1 ELSE 0 END AS truncated FROM test_records GROUP BY traj_id""")(
    lambda spark, sf: rounded(S.code_test_results(test_records(spark, sf), sparse=False, truncated=rollouts(spark, sf).select(
        "traj_id", (F.col("traj_id") % 2 == 0).alias("truncated"))), "traj_id", "truncated", score="score"))
C.add("code_test_results_pred", """, u AS (SELECT traj_id FROM rollouts EXCEPT SELECT traj_id FROM test_records)
SELECT traj_id, right('['||string_agg(chr(39)||actual||chr(39), ', ' ORDER BY test_idx)||']', 40) AS pred, CAST(NULL AS VARCHAR) AS feedback, max(CASE WHEN NOT passed AND contains(actual,'Error: ') THEN 1 ELSE 0 END) AS error_in_test_cases
FROM test_records GROUP BY traj_id UNION ALL SELECT traj_id, '', 'Failed to parse ground truth test cases.', 1 FROM u""")(
    lambda spark, sf: S.code_test_results(
        test_records(spark, sf), unparsed=rollouts(spark, sf).join(test_records(spark, sf), "traj_id", "left_anti"), pred_chars=40
    ).select("traj_id", "pred", "feedback", "error_in_test_cases"))
C.add("code_test_feedback_without_records", """SELECT traj_id, CASE WHEN traj_id IN (SELECT traj_id FROM test_records) THEN 'has records' ELSE 'No test execution information available.' END AS feedback FROM rollouts""")(
    lambda spark, sf: S.code_test_feedback(test_records(spark, sf), rollouts=rollouts(spark, sf)).select(
        "traj_id", F.when(F.col("feedback").startswith("No test"), F.col("feedback")).otherwise("has records").alias("feedback")))
C.add("code_pass_rate", """SELECT traj_id, round(CASE WHEN bool_and(passed) THEN 1 ELSE coalesce(avg(CASE WHEN passed THEN 1 ELSE 0 END) FILTER (test_idx<3),0) END,6)+0e0 AS pass_rate FROM test_records GROUP BY traj_id""")(
    lambda spark, sf: rounded(S.code_pass_rate(test_records(spark, sf), 3), "traj_id", pass_rate="pass_rate"))
C.add("code_test_feedback", """, r AS (SELECT *, CASE WHEN starts_with(actual,'Error: ') THEN 0 WHEN actual='Time out' THEN 1 ELSE 3 END AS lv FROM test_records WHERE NOT passed),
  k AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY lv, CASE WHEN lv<3 THEN 0 ELSE length(input)+length(actual) END, test_idx) AS rk, min(lv) OVER (PARTITION BY traj_id) AS top FROM r),
  p AS (SELECT traj_id, rk, CASE lv WHEN 0 THEN 'Runtime Error'||chr(10)||substr(actual,8)||chr(10)||chr(10)||'Last Executed Input'||chr(10)||input
     WHEN 1 THEN 'Time Limit Exceeded'||chr(10)||chr(10)||'Last Executed Input'||chr(10)||input
     ELSE 'Test Case '||(test_idx+1)||': Wrong Answer'||chr(10)||chr(10)||'Input'||chr(10)||input||chr(10)||chr(10)||'Output'||chr(10)||actual||chr(10)||chr(10)||'Expected'||chr(10)||expected END
     ||CASE WHEN debug<>'' THEN chr(10)||chr(10)||'Debug Output'||chr(10)||debug ELSE '' END AS t FROM k WHERE rk<=CASE WHEN top<3 THEN 1 ELSE 2 END),
  g AS (SELECT traj_id, string_agg(t, chr(10)||chr(10) ORDER BY rk) AS f FROM p GROUP BY traj_id)
SELECT traj_id, coalesce(f,'') AS feedback FROM (SELECT DISTINCT traj_id FROM test_records) LEFT JOIN g USING (traj_id)""")(
    lambda spark, sf: S.code_test_feedback(test_records(spark, sf)))


# ---------------------------------------------------------------- routing
# fixed values: one source per scorer
ROUTED = ["gsm8k", "gpqa", "sciknoweval", "code"]


def routed(spark, sf):
    n = F.col("n_chars").cast("string")
    body = pick(4, F.concat(F.lit(" \\boxed{"), n, F.lit("}")), F.concat(F.lit(" so "), letter()), F.concat(F.lit(" <answer>"), letter(), F.lit("</answer>")), F.lit(" code"))
    code = S.result(F.when(F.col("doc_id") % 8 == 3, 1.0).otherwise(0.0))
    return docs(spark, sf).select("doc_id", pick(4, *ROUTED).alias("data_source"), F.concat("text", body).alias("response"),
                                  F.when(F.col("doc_id") % 4 == 0, n).otherwise(letter()).alias("ground_truth"), code.alias("code"))


C.add("route_scores", "SELECT doc_id, CASE WHEN doc_id%4=3 AND doc_id%8<>3 THEN 0e0 ELSE 1e0 END AS score FROM documents")(
    lambda spark, sf: S.route_scores(routed(spark, sf), S.FEEDBACK_ROUTES, code="code").select("doc_id", r6(F.col("result")["score"]).alias("score")))
C.add("route_scores_default", """SELECT doc_id, CASE doc_id%4 WHEN 2 THEN CASE WHEN doc_id%8=2 THEN 1e0 ELSE -1e0 END WHEN 3 THEN 1e0 ELSE 1e0 END AS score FROM documents""")(
    lambda spark, sf: S.route_scores(docs(spark, sf).select(
        "doc_id", pick(4, "openai/gsm8k", "lighteval/MATH", "aime2024", "searchR1_nq").alias("data_source"), F.col("n_chars").cast("string").alias("ground_truth"),
        F.array("lang").alias("golden"), F.concat("text", pick(
            4, F.concat(F.lit(" #### "), F.col("n_chars").cast("string")), F.concat(F.lit(" \\boxed{"), F.col("n_chars").cast("string"), F.lit("}")),
            F.concat(F.lit("\nAnswer: "), F.when(F.col("doc_id") % 8 == 2, F.col("n_chars").cast("string")).otherwise("no")),
            F.concat(F.lit(" <answer>"), "lang", F.lit("</answer>")))).alias("response")), S.DEFAULT_ROUTES, golden="golden").select("doc_id", r6(F.col("result")["score"]).alias("score")))


def length_match(responses, truths, bonus=0.0):
    return [float(len(r) == int(t)) + bonus for r, t in zip(responses, truths)]


C.add("register_scorer", "SELECT doc_id, CASE WHEN doc_id%2=0 THEN 1.5e0 ELSE 0.5e0 END AS score FROM documents")(
    lambda spark, sf: docs(spark, sf).select("doc_id", S.batch_scorer(length_match, bonus=0.5)(
        "text", (F.col("n_chars") + F.col("doc_id") % 2).cast("string")).alias("result")).select("doc_id", r6(F.col("result")["score"]).alias("score")))


def picky(response, truth):
    if int(truth) % 5 == 0:
        raise ValueError("no")
    return float(len(response) == int(truth))


C.add("score_with_failures", "SELECT doc_id, CASE WHEN n_chars%5=0 THEN 0e0 ELSE 1e0 END AS score, n_chars%5=0 AS failed FROM documents")(
    lambda spark, sf: docs(spark, sf).select("doc_id", S.score_with_failures(picky, 5.0)("text", F.col("n_chars").cast("string")).alias("result")).select(
        "doc_id", r6(F.col("result")["score"]).alias("score"), F.col("result")["failed"].alias("failed")))
C.add("failure_counts", "SELECT count(*) AS rows, count(*) FILTER (n_chars%5=0) AS failed FROM documents")(
    lambda spark, sf: S.failure_counts(docs(spark, sf).select(S.score_with_failures(picky)("text", F.col("n_chars").cast("string")).alias("result"))))


CACHED = "SELECT doc_id, CASE WHEN t.d%2=0 THEN -1e0 ELSE length(text)+0e0 END AS result FROM documents JOIN (SELECT text, min(doc_id) AS d FROM documents GROUP BY text) t USING (text)"


@C.add("score_cache_buckets", CACHED)
def _(spark, sf):
    """A cache table in buckets, filled in two steps."""
    d = docs(spark, sf).select("doc_id", "text")
    first = d.groupBy("text").agg(F.min("doc_id").alias("d")).where("d % 2 = 0")
    name, path = f"scores_{uuid.uuid4().hex}", f"{shared_dir(spark).rstrip('/')}/rollframe-{uuid.uuid4().hex}"
    for part in (0, 2):
        cache = S.add_to_cache(first.where(F.col("d") % 4 == part).select(F.sha2("text", 256).alias("content_hash"), F.lit(-1.0).alias("result")), name, path, 8)
    scored, _ = S.score_cache(d, cache, lambda m: m.withColumn("result", F.length("text").cast("double")), ["text"], "doc_id", buckets=8)
    return scored.select("doc_id", "result")


@C.add("score_cache", CACHED)
def _(spark, sf):
    d = docs(spark, sf).select("doc_id", "text")
    first = d.groupBy("text").agg(F.min("doc_id").alias("d")).where("d % 2 = 0")
    cache = first.select(F.sha2("text", 256).alias("content_hash"), F.lit(-1.0).alias("result"))
    scored, _ = S.score_cache(d, cache, lambda m: m.withColumn("result", F.length("text").cast("double")), ["text"], "doc_id")
    return scored.select("doc_id", "result")


# ---------------------------------------------------------------- conversations and passages
@C.add("last_assistant_turn", """, l AS (SELECT conv_id, arg_max(text, turn) FILTER (role='assistant') AS said, conv_id%2=0 AND count(*) FILTER (role='assistant')>0 AS ok FROM conversations GROUP BY conv_id),
  r AS (SELECT *, coalesce(said||' #### '||CASE WHEN conv_id%2=0 THEN conv_id ELSE conv_id+1 END, '') AS r FROM l)
SELECT conv_id, CASE WHEN ok THEN 1e0 ELSE 0e0 END AS score, CASE WHEN ok THEN 'Your response is correct!' ELSE 'Your response is incorrect! You need to reflect on your answer and try again.' END AS reply, ok AS terminate, length(r) AS n FROM r""")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    c = c.withColumn("text", F.concat("text", F.lit(" #### "), F.when(F.col("conv_id") % 2 == 0, F.col("conv_id")).otherwise(F.col("conv_id") + 1).cast("string")))
    truths = c.select("conv_id", F.col("conv_id").cast("string").alias("ground_truth")).distinct()
    d = S.last_assistant_turn(c, truths)
    return rounded(d, "conv_id", "reply", "terminate", F.length("response").cast("long").alias("n"), score="score")


C.add("passages_to_string", """, p AS (SELECT conv_id AS query_id, turn+1 AS rank, text, split_part(text,chr(10),1) AS title, CASE WHEN contains(text,chr(10)) THEN text[strpos(text,chr(10))+1:] ELSE '' END AS body FROM conversations)
SELECT query_id, trim(string_agg('Doc '||rank||' (Title: '||title||')'||chr(10)||body||chr(10)||chr(10), '' ORDER BY rank), chr(10)||' ') AS passages FROM p GROUP BY query_id""")(
    lambda spark, sf: S.passages_to_string(table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.col("text").alias("contents"))))
C.add("join_passages", """, p AS (SELECT conv_id, conv_id%10 AS request, string_agg(role||turn, ',' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT request, string_agg(t, chr(10)||'---'||chr(10) ORDER BY conv_id) AS result FROM p GROUP BY request""")(
    lambda spark, sf: S.join_passages(table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("turn", "role"))), lambda m: F.concat(m["role"], m["turn"].cast("string"))), ",").alias("passages")).withColumn(
        "request", F.col("query_id") % 10), "request"))
C.add("topk_passages", """, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_cosine_similarity(a.v, b.v) AS score FROM e a, e b WHERE a.vec_id<>b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score,6)+0e0 AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank<=3""")(
    lambda spark, sf: rounded(S.topk_passages(table(spark, sf, "embeddings"), table(spark, sf, "embeddings"), 3), "query_id", "doc_id", "rank", score="score"))


@C.add("topk_recall", "SELECT count(*) AS queries, count(*)*10 AS wanted, true AS enough FROM embeddings")
def _(spark, sf):
    """Three quarters of the lists, as vectors without groups need, measured against the exact result over all queries."""
    e = table(spark, sf, "embeddings")
    lists = int(e.count() ** 0.5)
    found = R.topk_passages(e, e, 10, n_lists=lists, probes=lists * 3 // 4)
    return R.recall_at_k(found, R.topk_passages(e, e, 10)).select("queries", "wanted", (F.col("recall") >= 0.9).alias("enough"))
