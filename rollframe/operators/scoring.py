"""Rule scorers, routing by source, code test results and retrieved passages.

A scorer is a column expression over (response, ground truth) that gives one
struct, so that a whole table is scored in one pass whatever its sources.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.exprs import col, last_item
from ..functions.groups import attach_by_key
from .retrieval import topk_passages  # noqa: F401

# ---------------------------------------------------------------- fixed values
ERROR_PREFIX = "Error: "
TIMEOUT = "Time out"
INCORRECT_FORMAT = "Incorrect format"
WRONG_FORMAT_FEEDBACK = "Your answer had the wrong format. The solution must be given in the format: \\boxed{your_answer}."
TRUNCATED_FEEDBACK = "Your response was truncated because it exceeded the maximum length."
CORRECT_REPLY = "Your response is correct!"
INCORRECT_REPLY = "Your response is incorrect! You need to reflect on your answer and try again."
TRUNCATED_ATTEMPT = (
    "Truncated Attempt: Your previous response was too long and truncated because it reached the maximum response length. "
    "Try again with a shorter response."
)
UNPARSED_FEEDBACK = "Failed to parse ground truth test cases."
NO_TEST_FEEDBACK = "No test execution information available."
FORMAT_ATTEMPT = "Incorrect Format: Put your code inside a ```python ... ``` block."
FEEDBACK_ROUTES = {
    "code": ["code", "livecodebench", "humanevalplus"],
    "math": ["math", "math500", "dapo_math", "gsm8k", "aime24", "aime25"],
    "mcq_letter": ["gpqa"],
    "mcq_xml": ["sciknoweval"],
    "tooluse": ["tooluse"],
}
DEFAULT_ROUTES = {
    "hash": ["openai/gsm8k"],
    "boxed": ["lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500"],
    "minerva": ["math_dapo", "math", "math_dapo_reasoning"],
    "code": ["codecontests", "apps", "codeforces", "taco"],
    "think": ["hiyouga/geometry3k"],
    "qa": [
        "searchR1_nq", "searchR1_triviaqa", "searchR1_popqa", "searchR1_hotpotqa", "searchR1_2wikimultihopqa",
        "searchR1_musique", "searchR1_bamboogle",
    ],
}


def result(score: Column, acc: Column | None = None, pred=None, incorrect_format=None, truncated=None, missing=None, feedback=None) -> Column:
    """The struct every scorer gives."""
    num = lambda c: (F.lit(0) if c is None else c).cast("int")
    return F.struct(
        score.cast("double").alias("score"), (score if acc is None else acc).cast("double").alias("acc"),
        (F.lit("") if pred is None else pred).cast("string").alias("pred"), num(incorrect_format).alias("incorrect_format"),
        num(truncated).alias("truncated"), num(missing).alias("truncated_and_missing_answer"),
        (F.lit("") if feedback is None else feedback).cast("string").alias("feedback"),
    )


def _one(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


# ---------------------------------------------------------------- scorers
def score_hash_answer(response, truth, method="strict", format_score=0.0, full=1.0) -> Column:
    """0 without an answer, ``full`` if it equals the truth, else ``format_score``."""
    a = X.extract_hash_answer(response, method)
    s = F.when(a.isNull(), 0.0).when(a == col(truth), float(full)).otherwise(float(format_score))
    return result(s, pred=a)


def score_math_boxed(response, truth) -> Column:
    """The last boxed answer equals the truth after LaTeX normalisation.

    ``\\fbox`` is read as an answer by the extractor but never scores.
    """
    t = col(response)
    a = F.when(t.contains("\\boxed"), X.extract_last_boxed(t, fallbacks=True))
    return X.bind(a, lambda x: result(_one(X.latex_equal(x, col(truth))), pred=x))


def score_math_minerva(response, truth, strict_box=False) -> Column:
    """Last ``Answer:`` line (or strict box) of the last 300 characters; 1 or -1."""
    t = X.tail(response, X.TAIL_CHARS)
    if strict_box:
        pred = X.extract_last_boxed(X.tail(t, X.BOX_TAIL_CHARS))
        right = F.coalesce(pred == col(truth), F.lit(False))
    else:
        found = F.coalesce(last_item(X.findall(t, r"(?i)Answer\s*:\s*([^\n]+)")), F.lit("[INVALID]"))
        pred, wanted = X.final_answer_normal(found), X.final_answer_normal(col(truth))
        return X.bind(pred, lambda p: result(F.when(p == wanted, 1.0).otherwise(-1.0), _one(p == wanted), p))
    return result(F.when(right, 1.0).otherwise(-1.0), _one(right), pred)


def score_math_feedback(response, truth, truncated=None, format_feedback=True, correctness_feedback=False) -> Column:
    """Boxed answer in the last 100 characters equals the truth as written; says what went wrong."""
    cut = F.lit(False) if truncated is None else F.coalesce(col(truncated), F.lit(False))

    def judge(boxed: Column) -> Column:
        pred = F.coalesce(boxed, F.lit(""))
        right, bad, fb = (boxed == col(truth)) & boxed.isNotNull(), pred == "", F.lit("")
        if correctness_feedback:
            wrong = F.concat(F.lit("Your answer is incorrect. The correct answer is "), col(truth), F.lit("."))
            fb = F.when(~right, wrong).otherwise(fb)
        if format_feedback:
            fb = F.when(cut, TRUNCATED_FEEDBACK).when(bad, WRONG_FORMAT_FEEDBACK).otherwise(fb)
        return result(_one(right), None, pred, bad, cut, bad & cut, fb)

    return X.bind(X.extract_last_boxed(X.tail(response, X.BOX_TAIL_CHARS)), judge)


def score_qa_em(response, golden, format_score=0.0, full=1.0) -> Column:
    """Normalised exact match of the last answer tag with any golden answer; a quarter when there are over ten tags."""
    a = X.last_answer_tag(response)
    hit = F.exists(col(golden), lambda g: X.qa_normal(g) == X.qa_normal(a))
    spam = (X.count_of(response, "<answer>") > 10) | (X.count_of(response, "</answer>") > 10)
    s = F.when(a.isNull(), 0.0).when(hit & spam, full / 4).when(hit, float(full)).otherwise(float(format_score))
    return result(s, pred=a)


def score_qa_subem(response, golden, format_score=0.0, full=1.0) -> Column:
    """As ``score_qa_em`` with a golden answer inside the prediction, and no tag limit."""
    a = X.last_answer_tag(response)
    hit = F.exists(col(golden), lambda g: F.contains(X.qa_normal(a), X.qa_normal(g)))
    return result(F.when(a.isNull(), 0.0).when(hit, float(full)).otherwise(float(format_score)), pred=a)


def score_mcq_xml(response, truth) -> Column:
    """Text between the last ``<answer>`` and the next ``</answer>`` equals the letter.

    ``incorrect_format`` is 1 when the text does not end in a well-formed tag.
    """
    t = col(response)
    a = X.strip(F.substring_index(F.substring_index(t, "<answer>", -1), "</answer>", 1))
    well = t.rlike(r"<answer>\s*(A|B|C|D)\s*</answer>$")
    return result(_one(a == col(truth)), pred=a, incorrect_format=~well)


def score_mcq_letter(response, truth) -> Column:
    """Last lone A-D of the upper-cased text, else the bare text."""
    t = col(response)
    letter = last_item(X.findall(F.upper(t), r"(?U)\b(A|B|C|D)\b"))
    a = F.coalesce(letter, F.regexp_replace(X.strip(t), r"^\.+|\.+$", ""))
    a = F.regexp_replace(F.regexp_replace(a, r"\.+$", ""), r"/+$", "")
    return result(_one(a == col(truth)), pred=a, incorrect_format=~a.isin("A", "B", "C", "D"))


def score_mcq_cascade(response, truth) -> Column:
    """``answer is (X)``, else ``Answer: X``, else the last lone A-J."""
    t = col(response)
    first = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    lone = last_item(X.findall(t, r"(?U)\b([A-J])\b"))
    a = F.coalesce(first(r"(?i)answer is \(?([A-J])\)?"), first(r"(?i)Answer:\s*([A-J])"), lone, F.lit(""))
    return result(_one(a == col(truth)), pred=a, incorrect_format=~a.isin(*"ABCDEFGHIJ"))


JSON_TOKEN = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[a-z]+|[{}\[\],:]'


def _value(v: Column) -> Column:
    """A JSON value to compare by (keys sorted, equal numbers alike, true as 1 and false as 0) and to show."""
    tokens = F.regexp_extract_all(F.to_json(v), F.lit(JSON_TOKEN), F.lit(0))
    number = lambda t: F.regexp_replace(F.regexp_replace(t, r"\.0+$", ""), "^-0$", "0")
    plain = lambda t: F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "v string")["v"]
    alike = F.transform(
        tokens, lambda t: F.when(t == "true", "1").when(t == "false", "0").when(t.rlike("^-?[0-9]"), number(t)).otherwise(t)
    )
    shown = F.transform(
        tokens, lambda t: F.when(t == "true", "True").when(t == "false", "False").when(t == "null", "None")
        .when(t.isin(",", ":"), F.concat(t, F.lit(" "))).when(t.startswith('"'), F.concat(F.lit("'"), plain(t), F.lit("'"))).otherwise(t)
    )
    return F.struct(F.array_join(alike, "").alias("alike"), F.array_join(shown, "").alias("shown"))


def _merged(objects: Column) -> Column:
    """JSON object texts to one sorted list of (key, value) with typed values; a later key wins, a broken object is skipped."""
    parse = lambda j: F.transform_values(F.try_parse_json(j).try_cast("map<string,variant>"), lambda _, v: _value(v))
    maps = F.filter(F.transform(objects, parse), lambda m: m.isNotNull())
    empty = F.from_json(F.lit("{}"), "map<string,struct<alike:string,shown:string>>")
    one = F.aggregate(
        maps, empty, lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(m, k)), m)
    )
    return F.array_sort(F.map_entries(one))


def _quoted(names: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))


def _dict_text(entries: Column) -> Column:
    pair = lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"]["shown"])
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, pair), ", "), F.lit("}"))


def score_tooluse(response, truth) -> Column:
    """Same actions (as a multiset) and same merged inputs as the truth, a JSON list of ``Action, Action_Input``."""
    t, g = col(response), F.from_json(col(truth), "array<struct<Action:string,Action_Input:string>>")
    shaped = t.rlike(r"(?s)Action:.*?\nAction Input:.*?")
    read = F.struct(
        X.findall(t, r"(?U)Action:\s*(\w+)").alias("said"), F.transform(g, lambda a: a["Action"]).alias("want"),
        _merged(X.findall(t, r"(?s)Action Input:\s*(\{.*?\})")).alias("gave"), _merged(F.transform(g, lambda a: a["Action_Input"])).alias("need"),
    )

    def judge(x: Column) -> Column:
        alike = lambda entries: F.transform(entries, lambda e: F.struct(e["key"], e["value"]["alike"]))
        actions = F.array_sort(x["said"]) == F.array_sort(x["want"])
        inputs = alike(x["gave"]) == alike(x["need"])
        fb = F.concat_ws(
            "; ",
            F.when(~actions, F.concat(F.lit("Actions mismatch: predicted "), _quoted(x["said"]), F.lit(", expected "), _quoted(x["want"]))),
            F.when(~inputs, F.concat(F.lit("Action inputs mismatch: predicted "), _dict_text(x["gave"]), F.lit(", expected "), _dict_text(x["need"]))),
        )
        pred = F.concat(F.lit("Actions: "), _quoted(x["said"]), F.lit(", Inputs: "), _dict_text(x["gave"]))
        return result(_one(actions & inputs), pred=pred, incorrect_format=~shaped, feedback=fb)

    unread = result(F.lit(0.0), incorrect_format=F.lit(1), feedback=F.lit("Failed to parse ground truth JSON"))
    return F.when(g.isNull(), unread).otherwise(X.bind(read, judge))


def score_format_think(response, truth, format_score=0.1) -> Column:
    """Blend of boxed accuracy and whether the whole text is a think block followed by a box."""
    t = col(response)
    shaped = _one(t.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*\z"))

    def judge(a: Column) -> Column:
        return X.bind(_one(X.latex_equal(a, col(truth))), lambda acc: result((1 - format_score) * acc + format_score * shaped, acc, a))

    return X.bind(X.extract_last_boxed(t), judge)


# ---------------------------------------------------------------- registry and routing
SCORERS: dict[str, Callable[..., Column]] = {}


def register_scorer(name: str, fn: Callable[..., Column], **fixed) -> Callable[..., Column]:
    """Name a scorer ``fn(response, truth, **fixed) -> struct column``."""
    SCORERS[name] = (lambda r, t: fn(r, t, **fixed)) if fixed else fn
    return SCORERS[name]


def batch_scorer(fn: Callable[..., list[float]], **fixed) -> Callable[..., Column]:
    """A scorer from a Python function over lists of responses and truths, run on Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for r, t in batches:
            yield pd.Series(fn(list(r), list(t), **fixed), dtype="float64")

    return lambda response, truth: result(run(col(response), col(truth)))


def score_with_failures(fn: Callable[[str, str], float], seconds: float | None = None) -> Callable[..., Column]:
    """A scorer from a row function whose errors and time-outs score 0.0 and set ``failed``; the job goes on.

    The time limit interrupts Python code of the worker's main thread.
    """

    @F.pandas_udf("score double, failed boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import signal

        def stop(*_):
            raise TimeoutError

        def one(r, t):
            try:
                if seconds:
                    signal.signal(signal.SIGALRM, stop)
                    signal.setitimer(signal.ITIMER_REAL, seconds)
                return float(fn(r, t)), False
            except Exception:  # noqa: BLE001
                return 0.0, True
            finally:
                if seconds:
                    signal.setitimer(signal.ITIMER_REAL, 0)

        for r, t in batches:
            yield pd.DataFrame([one(a, b) for a, b in zip(r, t)], columns=["score", "failed"])

    return lambda response, truth: run(col(response), col(truth))


def failure_counts(scored: DataFrame, struct: str = "result") -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(struct)["failed"], 1)).alias("failed"))


# fixed names of the scorers
for _name, _fn in (
    ("hash", score_hash_answer), ("boxed", score_math_boxed), ("minerva", score_math_minerva), ("math", score_math_feedback),
    ("qa", score_qa_em), ("mcq_xml", score_mcq_xml), ("mcq_letter", score_mcq_letter), ("mcq_cascade", score_mcq_cascade),
    ("tooluse", score_tooluse), ("think", score_format_think),
):
    register_scorer(_name, _fn)


def route_scores(
    df: DataFrame, routes: dict[str, list[str]], source="data_source", response="response", truth="ground_truth", golden: str | None = None,
    code: str | None = None,
) -> DataFrame:
    """Adds ``result``: the struct of the scorer the row's source is routed to; an unknown source is an error.

    ``golden`` is the answer list for question answering, ``code`` a column
    with the struct of already aggregated test results.
    """
    src, out = F.col(source), None
    for name, sources in routes.items():
        if name == "code":
            if code is None:
                continue
            value = F.col(code)
        else:
            value = SCORERS[name](response, golden if name == "qa" and golden else truth)
        cond = src.isin(*sources)
        if name == "minerva":
            cond = cond | src.startswith("aime")
        out = F.when(cond, value) if out is None else out.when(cond, value)
    kind = "struct<score:double,acc:double,pred:string,incorrect_format:int,truncated:int,truncated_and_missing_answer:int,feedback:string>"
    unknown = F.raise_error(F.concat(F.lit("no scorer for data source "), src)).cast(kind)
    return df.withColumn("result", out.otherwise(unknown))


def add_to_cache(entries: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """Score cache ``name`` with more ``entries`` (``content_hash, result``): a table in ``path``, in buckets sorted by hash.

    Every call adds files to the buckets.  A hash that was added twice counts
    once, with either score.
    """
    write = entries.select("content_hash", "result").repartition(buckets, "content_hash").write.mode("append").format("parquet")
    write.bucketBy(buckets, "content_hash").sortBy("content_hash").option("path", path).saveAsTable(name)
    return entries.sparkSession.table(name)


def score_cache(
    df: DataFrame, cache: DataFrame, score: Callable[[DataFrame], DataFrame], content: list[str], key: str, out: str = "result",
    buckets: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Scores by content hash: known rows take theirs from ``cache`` (``content_hash, result``), only the others are scored.

    Copies collapse before the look-up, the cache is joined to one row per
    content and nothing else, and ``key`` spreads a much repeated content when
    its score goes back.  With a cache in ``buckets`` (``add_to_cache``) the
    contents are dealt like it, so that the cache is read and never shuffled.
    Returns the scored table and the new cache entries.
    """
    hashed = df.withColumn("content_hash", F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in content]), 256))
    dealt = hashed if buckets is None else hashed.repartition(buckets, "content_hash")
    known = cache.groupBy("content_hash").agg(F.first(F.struct(out)).alias("_known"))
    seen = dealt.dropDuplicates(["content_hash"]).join(known, "content_hash", "left")
    fresh = score(seen.where("_known IS NULL").drop("_known")).select("content_hash", out)
    both = seen.where("_known IS NOT NULL").select("content_hash", f"_known.{out}").unionByName(fresh)
    return attach_by_key(hashed, ["content_hash"], both).drop("content_hash"), fresh


# ---------------------------------------------------------------- code test results
def _listed(texts: Column) -> Column:
    """Texts as a Python list prints them."""
    def quoted(t: Column) -> Column:
        t = F.regexp_replace(t, r"\\", r"\\\\")
        for mark, shown in (("\n", r"\\n"), ("\t", r"\\t"), ("\r", r"\\r")):
            t = F.regexp_replace(t, mark, shown)
        double = t.contains("'") & ~t.contains('"')
        return F.when(double, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.regexp_replace(t, "'", r"\\'"), F.lit("'")))

    shown = F.transform(texts, lambda t: F.coalesce(X.bind(t, quoted), F.lit("None")))
    return F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))


def code_test_results(
    records: DataFrame, sparse: bool = True, truncated: DataFrame | None = None, unparsed: DataFrame | None = None, pred_chars: int = 5000
) -> DataFrame:
    """Test records to one row per rollout: accuracy, score, failure flags, and what the tests returned (``pred``, its last characters).

    ``truncated`` names cut rollouts (``traj_id, truncated``), ``unparsed`` those
    whose truth could not be read (``traj_id``): they score 0 with an error.
    The records of a rollout are the tests of one program.
    """
    bad = ~F.col("passed")
    answers = F.array_sort(F.collect_list(F.struct("test_idx", F.col("actual").alias("a"))))
    g = records.groupBy("traj_id").agg(
        F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)).alias("acc"), F.count(F.lit(1)).alias("n_tests"),
        F.max(F.when(bad & F.contains(F.col("actual"), F.lit(ERROR_PREFIX)), 1).otherwise(0)).alias("error_in_test_cases"),
        F.max(F.when(bad & (F.col("actual") == TIMEOUT), 1).otherwise(0)).alias("timed_out"),
        F.max(F.when(bad & (F.col("actual") == INCORRECT_FORMAT), 1).otherwise(0)).alias("_f"), answers.alias("_a"),
    )
    g = g.withColumn("score", F.when(F.col("acc") == 1.0, 1.0).otherwise(0.0) if sparse else F.col("acc"))
    g = g.withColumn("incorrect_format", F.when((F.col("n_tests") == 1) & (F.col("_f") == 1), 1).otherwise(0)).drop("_f")
    g = g.withColumn("pred", F.right(_listed(F.col("_a.a")), F.lit(pred_chars))).drop("_a")
    g = g.withColumn("feedback", F.lit(None).cast("string"))
    if unparsed is not None:
        g = g.unionByName(unparsed.select(
            "traj_id", F.lit(0.0).alias("acc"), F.lit(0).cast("long").alias("n_tests"), F.lit(1).alias("error_in_test_cases"), F.lit(0).alias("timed_out"),
            F.lit(0.0).alias("score"), F.lit(0).alias("incorrect_format"), F.lit("").alias("pred"), F.lit(UNPARSED_FEEDBACK).alias("feedback"),
        ))
    if truncated is not None:
        g = g.join(truncated.select("traj_id", F.col("truncated").cast("int").alias("truncated")), "traj_id", "left")
        g = g.withColumn("truncated", F.coalesce("truncated", F.lit(0)))
    else:
        g = g.withColumn("truncated", F.lit(0))
    missing = F.when(F.col("feedback").isNotNull(), F.col("truncated")).otherwise(F.col("incorrect_format") * F.col("truncated"))
    return g.withColumn("truncated_and_missing_answer", missing)


def code_pass_rate(records: DataFrame, first_n: int | None = 10) -> DataFrame:
    """Share of the first ``first_n`` tests that passed; 1 when all tests passed, 0 for a rollout without tests."""
    ok = F.when(F.col("passed"), 1.0).otherwise(0.0)
    seen = F.lit(True) if first_n is None else F.col("test_idx") < first_n
    return records.groupBy("traj_id").agg(
        F.when(F.min(ok) == 1.0, 1.0).otherwise(F.coalesce(F.avg(F.when(seen, ok)), F.lit(0.0))).alias("pass_rate")
    )


def code_test_feedback(
    records: DataFrame, max_tests: int = 2, max_chars: int = 2000, text_chars: int = 250, input_lines: int = 8, debug_lines: int = 10,
    debug_chars: int = 300, truncated: str | None = None, rollouts: DataFrame | None = None,
) -> DataFrame:
    """One feedback text per rollout: its first runtime error, else time-out, else format error, else the shortest wrong answers.

    At most ``max_tests`` records of a rollout are ranked, cut to that many
    before the shuffle; a rollout whose tests all passed gets an empty text, and
    one of ``rollouts`` (``traj_id``) without any record says so.
    """
    a = F.col("actual")
    is_error, is_timeout, is_format = a.startswith(ERROR_PREFIX), a == TIMEOUT, a == INCORRECT_FORMAT
    level = F.when(is_error, 0).when(is_timeout, 1).when(is_format, 2).otherwise(3)
    size = F.length(F.coalesce("input", F.lit("None"))) + F.length(a)
    d = records.where(~F.col("passed") | (level < 3)).withColumn("_lv", level)
    d = d.withColumn("_len", F.when(F.col("_lv") < 3, 0).otherwise(size))
    rank = F.row_number().over(W.partitionBy("traj_id").orderBy("_lv", "_len", "test_idx"))
    d = d.withColumn("_rk", rank).where(F.col("_rk") <= max_tests)
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)

    def block(c: Column, lines: int, chars: int) -> Column:
        parts = F.split(c, "\n")
        shown = F.transform(F.slice(parts, 1, lines), lambda p: cut(p, chars))
        more = F.when(F.size(parts) > lines, F.array(F.concat(F.lit("... ("), (F.size(parts) - lines).cast("string"), F.lit(" more lines)"))))
        return F.concat(shown, F.coalesce(more, F.array().cast("array<string>")))

    none = F.array().cast("array<string>")
    lines = lambda *t: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in t])
    given = F.when(F.col("input").isNull() | (F.col("input") == ""), none).otherwise(
        block(F.regexp_replace(F.col("input"), r"\n$", ""), input_lines, text_chars)
    )
    dbg = F.trim(F.coalesce("debug", F.lit("")))
    debug = F.when(dbg == "", none).otherwise(F.concat(lines("", "Debug Output"), block(dbg, debug_lines, debug_chars)))
    last_input = F.concat(lines("Last Executed Input"), given, debug)
    cut_off = F.lit(False) if truncated is None else F.col(truncated)
    expected = F.when(F.col("expected").isNull(), none).otherwise(lines("", "Expected", cut(F.col("expected"), text_chars)))
    wrong = F.concat(
        lines(F.concat(F.lit("Test Case "), (F.col("test_idx") + 1).cast("string"), F.lit(": Wrong Answer")), "", "Input"), given,
        lines("", "Output", cut(a, text_chars)), expected, debug,
    )
    part = (
        F.when(is_error, F.concat(lines("Runtime Error", F.substring(a, F.lit(len(ERROR_PREFIX) + 1), F.length(a)), ""), last_input))
        .when(is_timeout, F.concat(lines("Time Limit Exceeded", ""), last_input))
        .when(is_format, F.when(cut_off, lines(TRUNCATED_ATTEMPT)).otherwise(lines(FORMAT_ATTEMPT)))
        .otherwise(wrong)
    )
    d = d.withColumn("_text", F.array_join(part, "\n"))
    g = d.groupBy("traj_id").agg(
        F.min("_lv").alias("_top"), F.array_sort(F.collect_list(F.struct("_rk", "_lv", "_text"))).alias("_r")
    )
    # an error, time-out or format record stands alone
    shown = F.when(F.col("_top") < 3, F.slice("_r", 1, 1)).otherwise(F.col("_r"))
    text = F.regexp_replace(F.array_join(F.transform(shown, lambda r: r["_text"]), "\n\n"), r"\s+$", "")
    g = g.select("traj_id", F.left(text, F.lit(max_chars)).alias("feedback"))
    every = records.select("traj_id").distinct()
    out = every.join(g, "traj_id", "left").withColumn("feedback", F.coalesce("feedback", F.lit("")))
    if rollouts is not None:
        out = rollouts.select("traj_id").distinct().join(out, "traj_id", "left")
        out = out.withColumn("feedback", F.coalesce("feedback", F.lit(NO_TEST_FEEDBACK)))
    return out


# ---------------------------------------------------------------- conversations and passages
def last_assistant_turn(turns: DataFrame, truths: DataFrame, key: str = "conv_id", order: str = "turn", method: str = "strict") -> DataFrame:
    """Last assistant message of a conversation, its score, the reply to it and whether the conversation ends."""
    last = turns.groupBy(key).agg(F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col(order))).alias("response"))
    d = last.withColumn("response", F.coalesce("response", F.lit(""))).join(truths.select(key, "ground_truth"), key)
    d = d.withColumn("score", score_hash_answer("response", "ground_truth", method)["score"])
    done = F.col("score") == 1.0
    return d.withColumn("reply", F.when(done, CORRECT_REPLY).otherwise(INCORRECT_REPLY)).withColumn("terminate", done)


def passages_to_string(passages: DataFrame, query: str = "query_id", rank: str = "rank", content: str = "contents") -> DataFrame:
    """Ranked documents of a query as ``Doc i (Title: first line)`` texts, one text per query."""
    title, body = F.substring_index(content, "\n", 1), F.when(F.col(content).contains("\n"), F.regexp_replace(content, r"(?s)^[^\n]*\n", "")).otherwise("")
    one = F.concat(F.lit("Doc "), F.col(rank).cast("string"), F.lit(" (Title: "), title, F.lit(")\n"), body, F.lit("\n\n"))
    g = passages.withColumn("_d", one).groupBy(query).agg(F.array_sort(F.collect_list(F.struct(rank, "_d"))).alias("_l"))
    return g.select(query, X.strip(F.array_join(F.transform("_l", lambda d: d["_d"]), "")).alias("passages"))


def join_passages(per_query: DataFrame, request: str, query: str = "query_id") -> DataFrame:
    """The passage texts of one request's queries, joined by rulers."""
    g = per_query.groupBy(request).agg(F.array_sort(F.collect_list(F.struct(query, "passages"))).alias("_p"))
    return g.select(request, F.array_join(F.transform("_p", lambda p: p["passages"]), "\n---\n").alias("result"))
