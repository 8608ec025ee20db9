"""Raw rows into prompt, chat and preference tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col
from ..functions.groups import attach_by_key, number_rows, running_total
from .demos import fill

# ---------------------------------------------------------------- fixed values
MATH_TEMPLATE = "{problem}\n\nPlease reason step by step, and put your final answer within \\boxed{}."
CODE_TEMPLATE = (
    "You are a coding expert. You will be given a coding problem, and you need to write a correct Python program that "
    "matches the specification and passes all tests. The time limit is 1 second. You may start by outlining your thought "
    "process. In the end, please provide the complete code in a code block enclosed with ``` ```.\n\n{problem}"
)
EVALUATION_SUFFIX = " The solution will be evaluated in a {kind} environment."
NORMAL_COLUMNS = ["idx", "kind", "dataset", "answer", "elo", "prompt", "description", "tests", "embedding", "system"]
ANSWER_LINE_PREFIX = (
    "Solve the following math problem step by step. The last line of your response should be of the form Answer: $Answer "
    "(without quotes) where $Answer is the answer to the problem.\n\n"
)
ANSWER_LINE_SUFFIX = '\n\nRemember to put your answer on its own line after "Answer:".'
LETTER_TEMPLATE = (
    "Return your final response within \\boxed{} and only include the letter choice (A, B, C, or D) as your final response.\n"
    "Problem: {problem}\nOptions: {options}\nAnswer:"
)
SUBJECT_HEADER = (
    "The following are multiple choice questions (with answers) about {subject}. Think step by step and then finish your "
    'answer with "the answer is (X)" where X is the correct letter choice.'
)
BOXED_LETTER_TAIL = (
    "\nPlease reason step by step, and put your final answer option within \\boxed{}. Only put the option letter in the box, "
    "e.g. \\boxed{A}. There is only one correct answer."
)
LABELED_SYSTEM = (
    "\nGiven a question and four options, please select the right answer. Respond in the following format:\n<reasoning>\n...\n"
    "</reasoning>\n<answer>\n...\n</answer>\n\nFor the answer, only output the letter corresponding to the correct option "
    "(A, B, C, or D), and nothing else. Do not restate the answer text. For example, if the answer is \"A\", just output:\n"
    "<answer>\nA\n</answer>\n"
)
SEARCH_SYSTEM = "You are a helpful and harmless assistant."
SEARCH_USER_PREFIX = (
    "Answer the given question. You must conduct reasoning inside <think> and </think> first every time you get new "
    "information. After reasoning, if you find you lack some knowledge, you can call a search engine by <tool_call> query "
    "</tool_call> and it will return the top searched results between <tool_response> and </tool_response>. You can search "
    "as many times as your want. If you find no further external knowledge needed, you can directly provide the answer "
    "inside <answer> and </answer>, without detailed illustrations. For example, <answer> Beijing </answer>. Question: "
)
HASH_INSTRUCTION = 'Let\'s think step by step and output the final answer after "####".'
BOXED_INSTRUCTION = "Let's think step by step and output the final answer within \\boxed{}."
SIGNATURE_NOTE = "\n\nYour solution should have the following signature: ```python\n{signature}\n```"
RETRY_PREFIX = "The following is feedback from your unsuccessful earlier attempt:\n\n"
RETRY_SUFFIX = "\n\nCorrectly solve the original question."
# lines that end a problem's description: input headers, examples, code fences, rulers
DESCRIPTION_END = (
    r"(?im)^[ \t]*(?:\#[ \t]*)*(?:"
    r"[ \t]*[-=_()\[\]<>|~*–—−]*[ \t]*(?:(?:input[ \t]*(?:format|specification|section)|input[ \t]*(?:and|/|&)[ \t]*output|input))[ \t]*:?[ \t]*[-=_()\[\]<>|~*–—−]*[ \t]*(?:\r?\n)"
    r"|[ \t]*[-=_()\[\]<>|~*–—−]*[ \t]*(?:(?:input[ \t]*(?:format|specification|section)|input[ \t]*(?:and|/|&)[ \t]*output|input)):?[ \t]*(?:[-–—−])[^\n]*(?:\r?\n)"
    r"|[ \t]*[-=_()\[\]<>|~*–—−]*[ \t]*examples[ \t]*(?:\d+)?[ \t]*:?[ \t]*[-=_()\[\]<>|~*–—−]*[ \t]*(?:\r?\n)"
    r"|[ \t]*[-=_()\[\]<>|~*–—−]*[ \t]*example[ \t]*(?:\d+)?[ \t]*:?[ \t]*[-=_()\[\]<>|~*–—−]*[ \t]*(?:\r?\n)"
    r"|.*for[ \t]+example[ \t]*:[^\n]*(?:\r?\n)"
    r"|.*```[^\n]*(?:\r?\n)"
    r"|.*-----[^\n]*(?:\r?\n)"
    r")"
)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _blank(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\s", "")) == 0


def strip(c: str | Column) -> Column:
    """Trim of any white space on both ends, line breaks included."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


# ---------------------------------------------------------------- prompt schema
def to_prompt_schema(df: DataFrame, split: str) -> DataFrame:
    """Source columns into ``data_source, prompt, ability, reward_model, extra_info``.

    Code rows carry their tests as ground truth; ``achievement_prior`` is kept
    in train only; ``(self, `` goes from signatures of one source.
    """
    unself = lambda c: F.when(F.col("dataset") == "livecodebench", F.replace(F.col(c), F.lit("(self, "), F.lit("("))).otherwise(F.col(c))
    question = unself("prompt")
    user = F.array(message("user", question))
    prompt = user
    if "system" in df.columns:
        prompt = F.when(F.col("system").isNotNull(), F.concat(F.array(message("system", F.col("system"))), user)).otherwise(user)
    prior = F.col("achievement_prior").cast("double") if split == "train" and "achievement_prior" in df.columns else F.lit(0.0)
    truth = F.when(F.col("kind") == "code", F.col("tests")).otherwise(F.col("answer"))
    return df.select(
        F.col("dataset").alias("data_source"),
        prompt.alias("prompt"),
        F.col("kind").alias("ability"),
        F.struct(F.col("kind").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(
            F.lit(split).alias("split"), F.col("idx").cast("string").alias("index"), unself("description").alias("description"),
            question.alias("problem"), F.col("elo").cast("string").alias("elo"), prior.alias("achievement_prior"),
        ).alias("extra_info"),
    )


def normalize_columns(df: DataFrame, dataset: str, order: str) -> DataFrame:
    """Common columns of every source: row index, ``-`` for missing values, the evaluation note, fixed order."""
    d = number_rows(df, order, "idx").withColumn("idx", F.col("idx") - 1)
    fallback = {"tests": "-", "answer": "-", "dataset": "-", "elo": "-"}
    absent = {"tests": "-", "answer": "-", "dataset": dataset, "elo": "-"}
    for c in fallback:
        d = d.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(fallback[c])) if c in df.columns else F.lit(absent[c]))
    d = d.withColumn("description", F.concat(F.col("description"), fill(EVALUATION_SUFFIX, kind=F.col("kind"))))
    return d.select(*[c for c in NORMAL_COLUMNS if c in d.columns])


def prompt_template(df: DataFrame, problem: str = "problem", kind: str = "kind") -> DataFrame:
    """Adds ``prompt``: the problem in the code or the math template."""
    p = F.col(problem)
    return df.withColumn("prompt", F.when(F.col(kind) == "code", fill(CODE_TEMPLATE, problem=p)).otherwise(fill(MATH_TEMPLATE, problem=p)))


def without_affixes(text: Column, prefix: str = ANSWER_LINE_PREFIX, suffix: str = ANSWER_LINE_SUFFIX) -> Column:
    head = F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)
    cut = F.when(head.endswith(suffix), F.substring(head, F.lit(1), F.length(head) - len(suffix))).otherwise(head)
    return strip(cut)


def strip_affixes(
    df: DataFrame, prompt: str = "prompt", prefix: str = ANSWER_LINE_PREFIX, suffix: str = ANSWER_LINE_SUFFIX, template: str = MATH_TEMPLATE
) -> DataFrame:
    """Take another template's wording off the last message and wrap it anew; adds the bare ``problem``."""
    d = df.withColumn("problem", without_affixes(F.element_at(F.col(prompt), -1)["content"], prefix, suffix))
    body = F.slice(F.col(prompt), F.lit(1), F.size(prompt) - 1)
    last = F.struct(F.element_at(F.col(prompt), -1)["role"].alias("role"), fill(template, problem=F.col("problem")).alias("content"))
    return d.withColumn(prompt, F.concat(body, F.array(last)))


def unboxed(answer: Column) -> Column:
    """Content of a text that is one boxed expression as a whole, else the text."""
    whole = answer.startswith("\\boxed{") & answer.endswith("}")
    return F.when(whole, F.substring(answer, F.lit(8), F.length(answer) - 8)).otherwise(answer)


def hash_number(answer: Column) -> Column:
    """Number behind ``####`` without commas, empty when there is none."""
    return F.replace(F.regexp_extract(answer, r"####\s*([0-9,]+(?:\.[0-9]+)?)", 1), F.lit(","), F.lit(""))


def plain_hash_number(answer: Column) -> Column:
    """Plain number behind ``####``: no sign, no commas; empty when there is none."""
    return F.regexp_extract(answer, r"####\s*([0-9]+(?:\.[0-9]+)?)", 1)


ANSWER_TRANSFORMS = {"none": lambda a: a, "unbox": unboxed, "hash": hash_number, "plain_hash": plain_hash_number}


def _math_row(df: DataFrame, source: Column, problem: Column, truth: Column, split: str, index: Column, reference=None, origin=None) -> DataFrame:
    model = [F.lit("math").alias("style"), truth.alias("ground_truth")]
    if reference is not None:
        model.append(reference.alias("reference"))
    info = [F.lit(split).alias("split"), index.cast("string").alias("index"), problem.alias("description"), problem.alias("problem")]
    if origin is not None:
        info.append(origin.alias("source"))
    return df.select(
        source.alias("data_source"), F.array(message("user", fill(MATH_TEMPLATE, problem=problem))).alias("prompt"),
        F.lit("math").alias("ability"), F.struct(*model).alias("reward_model"), F.struct(*info).alias("extra_info"),
    )


def format_math_train(
    df: DataFrame, order: str, problem: str = "problem", answer: str = "answer", solution: str | None = "solution", source: str | None = "source",
    split: str = "train",
) -> DataFrame:
    """Rows with a problem and an answer, trimmed, the answer unboxed, the reference solution kept if there is one."""
    d = df.where(~F.coalesce(_blank(F.col(problem)), F.lit(True)) & ~F.coalesce(_blank(F.col(answer)), F.lit(True)))
    d = number_rows(d, order, "_i").withColumn("_i", F.col("_i") - 1)
    ref = F.col(solution) if solution and solution in df.columns else None
    origin = F.col(source) if source and source in df.columns else F.lit("math")
    return _math_row(d, F.lit("math"), strip(problem), unboxed(strip(answer)), split, F.col("_i"), ref, origin)


def format_eval_set(
    df: DataFrame, name: str, order: str, problem: str = "problem", answer: str = "answer", answer_transform: str = "none", split: str = "test"
) -> DataFrame:
    """An evaluation source with its own column names and answer rule."""
    d = number_rows(df, order, "_i").withColumn("_i", F.col("_i") - 1)
    truth = ANSWER_TRANSFORMS[answer_transform](F.col(answer).cast("string"))
    return _math_row(d, F.lit(name), F.col(problem), truth, split, F.col("_i"))


# ---------------------------------------------------------------- multiple choice
def format_mcq_shuffle(df: DataFrame, key: str, question: str, correct: str, wrong: Sequence[str], seed: int = 0) -> DataFrame:
    """Answers in a hash order, lettered; adds ``options, answer, prompt``."""
    answers = F.array(*[F.col(c) for c in (correct, *wrong)])
    rank = lambda a: F.md5(F.concat_ws("|", F.col(key).cast("string"), a, F.lit(str(seed))))
    ordered = F.transform(F.array_sort(F.transform(answers, lambda a: F.struct(rank(a).alias("h"), a.alias("a")))), lambda s: s["a"])
    d = df.withColumn("_o", ordered)
    lettered = F.transform("_o", lambda a, i: F.concat(F.char(F.lit(65) + i), F.lit(") "), a))
    d = d.withColumn("options", F.array_join(lettered, ", "))
    d = d.withColumn("answer", F.char(F.lit(64) + F.array_position(F.col("_o"), F.col(correct))))
    return d.withColumn("prompt", fill(LETTER_TEMPLATE, problem=F.col(question), options=F.col("options"))).drop("_o")


def format_mcq_options(df: DataFrame, question: str, options: str, subject: str | None = None, style: str = "cot") -> DataFrame:
    """Adds ``prompt`` with one lettered line per option (at most 16), asking for a chain of thought or a boxed letter."""
    too_many = F.raise_error(F.lit("more than 16 options")).cast("array<string>")
    opts = F.when(F.size(options) <= 16, F.col(options)).otherwise(too_many)
    mark = {"cot": ". ", "boxed": ": "}[style]
    lines = F.array_join(F.transform(opts, lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(mark), o, F.lit("\n"))), "")
    if style == "cot":
        head = fill(SUBJECT_HEADER, subject=F.col(subject))
        text = F.concat(head, F.lit("\nQuestion:\n"), F.col(question), F.lit("\nOptions:\n"), lines, F.lit("Answer: Let's think step by step."))
    else:
        text = F.concat(F.col(question), F.lit("\nOptions are:\n"), lines, F.lit(BOXED_LETTER_TAIL))
    return df.withColumn("prompt", text)


def format_labeled_choices(df: DataFrame, question: str = "question", choices: str = "choices", answer: str = "answerKey") -> DataFrame:
    """``choices`` holds parallel ``label`` and ``text`` arrays; adds the common columns of a multiple-choice source."""
    lines = F.zip_with(F.col(choices)["label"], F.col(choices)["text"], lambda l, t: F.concat(l, F.lit(": "), t))  # noqa: E741
    prompt = F.concat(F.col(question), F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\nPlease reason step by step."))
    return df.select(
        "*", F.lit("sciknoweval").alias("dataset"), F.lit(LABELED_SYSTEM).alias("system"), prompt.alias("prompt"),
        F.col(answer).alias("answer"), F.lit(None).cast("string").alias("tests"), F.col(question).alias("description"),
        F.lit("mcq").alias("kind"), F.lit(1500).alias("elo"),
    )


# ---------------------------------------------------------------- coding problems
# fixed values: headings of the two HTML layouts
HTML_SECTIONS = {
    "short": (("Input", "input"), ("Output", "output")),
    "long": (("Input Format", "input_format"), ("Output Format", "output_format")),
}
HTML_OPTIONAL = {
    "short": (("Interaction", "interaction"), ("Note", "note")),
    "long": (("Interaction", "interaction_format"), ("Note", "note"), ("Editorial", "editorial")),
}


def html_problem(df: DataFrame, layout: str = "short", out: str = "problem") -> DataFrame:
    """Title, limit and sections as HTML.  Optional sections appear when they have text; examples never do."""
    section = lambda h, c: F.concat(F.lit(f"<h2>{h}</h2><div>"), F.col(c), F.lit("</div>"))
    parts = [
        F.concat(F.lit("<html><body><h1>"), F.col("title"), F.lit("</h1>")),
        F.concat(F.lit("<div>Time limit per test: "), F.col("time_limit").cast("string"), F.lit(" s</div>")),
        section("Description", "description"),
        *[section(h, c) for h, c in HTML_SECTIONS[layout]],
        *[F.when(F.length(c) > 0, section(h, c)) for h, c in HTML_OPTIONAL[layout]],
        F.lit("</body></html>"),
    ]
    return df.withColumn(out, F.concat_ws("", *parts))


def tests_to_json(pairs: Column, testtype: Column, fn_name: Column, time_limit: Column) -> Column:
    """``input, output`` pairs as one JSON test set."""
    return F.to_json(F.struct(
        F.transform(pairs, lambda p: p["input"]).alias("inputs"), F.transform(pairs, lambda p: p["output"]).alias("outputs"),
        testtype.alias("testtype"), fn_name.alias("fn_name"), time_limit.cast("double").alias("time_limit"),
    ))


def test_type(fn_name: Column, declared: Column | None = None) -> Column:
    """``functional`` for function calls, else ``stdin``."""
    is_call = declared == "function_call" if declared is not None else F.coalesce(fn_name, F.lit("")) != ""
    return F.when(is_call, "functional").otherwise("stdin")


def parse_limit_default(value: Column, default: float) -> Column:
    """First word of ``"2 seconds"`` as a number, the default on null or blank."""
    text = F.trim(value.cast("string"))
    return F.when(text.isNull() | (text == ""), F.lit(float(default))).otherwise(F.element_at(F.split(text, r"\s+"), 1).cast("double"))


def problem_description(problem: str | Column, min_length: int = 10) -> Column:
    """Text in front of the first separator line; a dangling dash line goes, too short a rest is empty."""
    head = F.element_at(F.split(col(problem), DESCRIPTION_END, 2), 1)
    bare = F.regexp_replace(head, r"\s+$", "")
    dangling = bare.endswith("-") & bare.contains("\n")
    cut = F.when(dangling, F.regexp_replace(bare, r"\n[^\n]*$", "")).otherwise(head)
    return F.when(F.length(cut) < min_length, F.lit("")).otherwise(strip(cut))


def code_signature(starter: str | Column) -> Column:
    """Text behind the first ``def`` of the starter code, up to an input block."""
    body = F.element_at(F.split(F.element_at(F.split(col(starter), "def "), 2), "Input\n"), 1)
    return F.concat(F.lit("def "), strip(body))


def function_name(code: str | Column) -> Column:
    return F.trim(F.element_at(F.split(F.element_at(F.split(col(code), "def "), 2), r"\("), 1))


def with_signature(problem: Column, starter: Column) -> Column:
    """Append the signature note where there is starter code with a function."""
    has = F.coalesce(~_blank(starter) & starter.contains("def "), F.lit(False))
    return F.when(has, F.concat(problem, fill(SIGNATURE_NOTE, signature=code_signature(starter)))).otherwise(problem)


def docstring_description(problem: Column, fn_name: Column) -> Column:
    """First docstring behind ``def name``, up to the examples; a text without one is an error."""
    at = F.position(F.concat(F.lit("def "), fn_name), problem)
    rest = F.substring(problem, at, F.length(problem))
    double = F.element_at(F.split(rest, '"""'), 2)
    single = F.element_at(F.split(rest, "'''"), 2)
    none = F.raise_error(F.lit("no docstring behind the function")).cast("string")
    doc = F.when(rest.contains('"""'), double).when(rest.contains("'''"), single).otherwise(none)
    return strip(F.element_at(F.split(doc, ">>>"), 1))


# ---------------------------------------------------------------- question sources
def _rule_row(df: DataFrame, source: str, question: Column, content: Column, truth: Column, split: str, index: Column, answer: Column) -> DataFrame:
    return df.select(
        F.lit(source).alias("data_source"), F.array(message("user", content)).alias("prompt"), F.lit("math").alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.alias("index"), answer.alias("answer"), question.alias("question")).alias("extra_info"),
    )


def signed_hash_number(answer: Column) -> Column:
    """Number behind ``#### `` with its sign, commas dropped; a text without one is an error."""
    hit = F.regexp_extract(answer, r"#### (-?[0-9.,]+)", 1)
    none = F.raise_error(F.lit("no answer behind ####")).cast("string")
    return F.when(hit != "", F.replace(hit, F.lit(","), F.lit(""))).otherwise(none)


def gsm8k_prompt(df: DataFrame, index: str, split: str, question: str = "question", answer: str = "answer") -> DataFrame:
    content = F.concat(F.col(question), F.lit(" " + HASH_INSTRUCTION))
    return _rule_row(df, "openai/gsm8k", F.col(question), content, signed_hash_number(F.col(answer)), split, F.col(index), F.col(answer))


def boxed_prompt(df: DataFrame, index: str, split: str, truth: Column, problem: str = "problem", solution: str = "solution",
                 source: str = "DigitalLearningGmbH/MATH-lighteval") -> DataFrame:
    """Problem with the boxed instruction; ``truth`` is the boxed answer of the solution."""
    content = F.concat(F.col(problem), F.lit(" " + BOXED_INSTRUCTION))
    return _rule_row(df, source, F.col(problem), content, truth, split, F.col(index), F.col(solution))


def clean_context(text: Column) -> Column:
    """Trimmed text without bracketed markers; a title marker becomes a sentence end."""
    t = F.replace(strip(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(t, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def hellaswag_prompt(df: DataFrame, index: str, split: str) -> DataFrame:
    """Sentence completion from ``ctx_a, ctx_b, activity_label, endings, label``; rows without a label go."""
    d = df.where(F.length("label") > 0)
    b = F.col("ctx_b")
    capital = F.concat(F.upper(F.substring(b, 1, 1)), F.lower(F.substring(b, F.lit(2), F.length(b))))
    query = clean_context(F.concat(F.col("activity_label"), F.lit(": "), F.col("ctx_a"), F.lit(" "), capital))
    return d.select(
        F.lit("Rowan/hellaswag").alias("data_source"), F.array(message("user", query)).alias("prompt"), F.lit("nlp").alias("ability"),
        F.struct(
            F.lit("model").alias("style"), F.lit("multiple_choice").alias("eval"), F.col("label").cast("int").alias("ground_truth"),
            F.transform("endings", clean_context).alias("choices"),
        ).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col(index).alias("index")).alias("extra_info"),
    )


def preference_to_sft(df: DataFrame) -> DataFrame:
    """Two rows per preference: the prompt with the chosen and with the rejected answer."""
    return df.select("prompt", F.explode(F.array("chosen", "rejected")).alias("response"))


def preference_rl_prompts(df: DataFrame, index: str, split: str, source: str, response: str = "response") -> DataFrame:
    return df.select(
        F.lit(source).alias("data_source"), F.array(message("user", F.col("prompt"))).alias("prompt"), F.lit("alignment").alias("ability"),
        F.struct(F.lit("model").alias("style"), F.col(response).alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col(index).alias("index")).alias("extra_info"),
    )


def qa_prompt_with_tools(df: DataFrame, index: str, split: str, system: str = SEARCH_SYSTEM, prefix: str = SEARCH_USER_PREFIX) -> DataFrame:
    """Question answering with a search tool: tagged source, ground truth from ``reward_model`` else ``golden_answers``."""
    q = F.coalesce("question", F.lit(""))
    tag = F.concat(F.lit("searchR1_"), F.coalesce("data_source", F.lit("")))
    truth = F.coalesce(F.col("reward_model.ground_truth"), F.col("golden_answers"))
    create = F.struct(truth.alias("ground_truth"), q.alias("question"), tag.alias("data_source"))
    tools = F.struct(F.struct(create.alias("create_kwargs")).alias("search"))
    return df.select(
        tag.alias("data_source"),
        F.array(message("system", F.lit(system)), message("user", F.concat(F.lit(prefix.rstrip("\n")), q))).alias("prompt"),
        F.col("ability"), F.col("reward_model"),
        F.struct(
            F.col(index).alias("index"), F.lit(True).alias("need_tools_kwargs"), q.alias("question"), F.lit(split).alias("split"),
            tools.alias("tools_kwargs"),
        ).alias("extra_info"),
        F.col("metadata"),
    )


def add_tool_kwargs(df: DataFrame, tool: str, truth: str = "reward_model.ground_truth", query: str | None = None, agent: str | None = None) -> DataFrame:
    """Tool, interaction and agent settings in ``extra_info``, from the row's ground truth."""
    create = F.struct(F.struct(F.col(truth).alias("ground_truth")).alias("create_kwargs"))
    info = F.col("extra_info").withField("need_tools_kwargs", F.lit(True)).withField("tools_kwargs", F.struct(create.alias(tool)))
    if query:
        info = info.withField("interaction_kwargs", F.struct(F.col(query).alias("query"), F.col(truth).alias("ground_truth")))
    d = df.withColumn("extra_info", info)
    return d.withColumn("agent_name", F.lit(agent)) if agent else d


def qa_to_messages(df: DataFrame, question: str = "question", answer: str = "answer", instruction: str = HASH_INSTRUCTION) -> DataFrame:
    asked = F.concat(F.col(question), F.lit(" " + instruction))
    return df.withColumn("messages", F.array(message("user", asked), message("assistant", F.col(answer))))


def sharegpt_to_messages(df: DataFrame, conversations: str = "conversations") -> DataFrame:
    """``from/value`` turns as ``role/content``; an unknown speaker is an error."""
    bad = F.raise_error(F.lit("unknown role in a conversation")).cast("string")
    role = lambda s: F.when(s == "gpt", "assistant").when(s == "human", "user").otherwise(bad)
    return df.withColumn(
        "messages", F.transform(conversations, lambda m: F.struct(role(m["from"]).alias("role"), m["value"].alias("content")))
    ).drop(conversations)


def rows_to_conversation(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """One row per conversation with its ordered ``messages``."""
    g = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(role).alias("role"), F.col(content).alias("content")))).alias("_m"))
    return g.select(key, F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def conversation_to_rows(df: DataFrame, key: str = "conv_id") -> DataFrame:
    return df.select(key, F.posexplode("messages").alias("turn", "_m")).select(key, "turn", "_m.role", "_m.content")


def split_media_segments(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", content: str = "text", n_images: str = "n_images", n_videos: str = "n_videos"
) -> DataFrame:
    """Message segments ``seg_no, type, text, media_no`` in order; placeholders are numbered over the conversation.

    ``ok`` is false for conversations whose placeholders do not match their
    lists of images and videos.
    """
    marked = F.regexp_replace(F.col(content), r"(<image>|<video>)", "\u0001$1\u0001")
    pieces = F.filter(F.split(marked, "\u0001"), lambda p: p != "")
    is_img, is_vid = (lambda p: p == "<image>"), (lambda p: p == "<video>")
    count = lambda a, f: F.size(F.filter(a, f)).cast("long")
    d = turns.withColumn("_p", pieces).withColumn("_i", count(F.col("_p"), is_img)).withColumn("_v", count(F.col("_p"), is_vid))
    d = running_total(d, [key], order, {"_ci": F.col("_i"), "_cv": F.col("_v")})
    total = turns.withColumn("_p", pieces).groupBy(key).agg(
        F.sum(count(F.col("_p"), is_img)).alias("_ti"), F.sum(count(F.col("_p"), is_vid)).alias("_tv")
    )
    d = attach_by_key(d, [key], total).withColumn("ok", (F.col("_ti") == F.col(n_images)) & (F.col("_tv") == F.col(n_videos)))

    def numbered(p: Column, i: Column) -> Column:
        before = F.slice(F.col("_p"), F.lit(1), i)
        img = F.col("_ci") - F.col("_i") + count(before, is_img)
        vid = F.col("_cv") - F.col("_v") + count(before, is_vid)
        kind = F.when(is_img(p), "image").when(is_vid(p), "video").otherwise("text")
        return F.struct(
            i.alias("seg_no"), kind.alias("type"), F.when(kind == "text", p).alias("text"),
            F.when(is_img(p), img).when(is_vid(p), vid).alias("media_no"),
        )

    return d.select(key, order, "ok", F.inline(F.transform("_p", numbered)))


def rl_row_defaults(df: DataFrame, need_tools: bool = False) -> DataFrame:
    """Lift ``index, tools_kwargs, interaction_kwargs`` out of ``extra_info`` (JSON text) with their defaults.

    ``missing_tools`` marks rows that need tool settings and have none.
    """
    info = F.coalesce("extra_info", F.lit("{}"))
    part = lambda n, d: F.coalesce(F.get_json_object(info, f"$.{n}"), F.lit(d))
    need = F.coalesce(F.get_json_object(info, "$.need_tools_kwargs").cast("boolean"), F.lit(need_tools))
    d = df.withColumns({
        "index": part("index", "0"), "tools_kwargs": part("tools_kwargs", "{}"), "interaction_kwargs": part("interaction_kwargs", "{}"),
    })
    return d.withColumn("extra_info", info).withColumn("missing_tools", need & (F.col("tools_kwargs") == "{}"))


# ---------------------------------------------------------------- retries
def multiturn_retry_prompt(attempts: DataFrame, template: str, question: str = "question", key: str = "question_id", order: str = "turn") -> DataFrame:
    """Next prompt of each question from its failed ``response, feedback`` turns, as messages.

    A question without turns carries one row with null feedback.  The history of
    one question fits one row, as the prompt it becomes does.
    """
    done = F.when(F.col("feedback").isNotNull(), F.struct(order, "response", "feedback"))
    g = attempts.groupBy(key).agg(F.any_value(question).alias("_q"), F.array_sort(F.collect_list(done)).alias("_h"))
    wrapped = lambda text: F.concat(F.lit(RETRY_PREFIX), text, F.lit(RETRY_SUFFIX))
    first = F.array(message("user", F.col("_q")))
    if template == "feedback_only":
        told = F.concat(F.col("_q"), F.lit("\n\n"), wrapped(F.array_join(F.col("_h.feedback"), "\n\n")))
        messages = F.when(F.size("_h") == 0, first).otherwise(F.array(message("user", told)))
    elif template == "attempt_and_feedback":
        pairs = F.transform("_h", lambda h: F.array(message("assistant", h["response"]), message("user", wrapped(h["feedback"]))))
        messages = F.concat(first, F.flatten(pairs))
    else:
        raise ValueError(f"unknown template {template!r}")
    return g.select(key, messages.alias("messages"))


def trim_history_to_budget(turns: DataFrame, budget: int, length: Column, key: str = "conv_id", order: str = "turn", fixed: Column | None = None) -> DataFrame:
    """Drop the oldest turns until the rest, plus a fixed length per row, fits; a suffix of the history stays."""
    d = running_total(turns.withColumn("_len", length.cast("long")), [key], order, {"_tail": F.col("_len")}, descending=True)
    room = F.lit(budget) - (fixed if fixed is not None else F.lit(0))
    return d.where(F.col("_tail") <= room).drop("_len", "_tail")
