"""Answer extraction and normalisation as column expressions, inside the JVM throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col, last_item

# ---------------------------------------------------------------- fixed values
TAIL_CHARS = 300
BOX_TAIL_CHARS = 100
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
FINAL_ANSWER_SUBSTITUTIONS = [
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    (r"\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
]
FINAL_ANSWER_REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet",
    "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets",
    "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", r"\mathrm{th}",
    r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots",
]
LATEX_REMOVED_FIRST = ["\n", "\\!"]
LATEX_RENAMED = [("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac")]
LATEX_REMOVED = ["\\left", "\\right", "^{\\circ}", "^\\circ", "\\$"]


def tail(text: str | Column, n: int) -> Column:
    return F.right(col(text), F.lit(n))


def findall(text: str | Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))


def strip(text: str | Column) -> Column:
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


# ---------------------------------------------------------------- boxed answers
def _content(text: Column, macro: str) -> Column:
    """What the last ``macro{...}`` encloses, null when it is missing or never closed.

    The text behind the last marker is cut after every brace; a fold over the
    pieces counts the depth, at first one, until it is zero.
    """
    marker = macro + "{"

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece.endswith("{"), 1).otherwise(-1)
        going = state["depth"] > 0
        return F.struct(
            F.when(going, depth).otherwise(state["depth"]).alias("depth"),
            (state["size"] + F.when(going, F.length(piece)).otherwise(0)).alias("size"),
        )

    def read(rest: Column) -> Column:
        pieces = F.regexp_extract_all(rest, F.lit(r"[^{}]*[{}]"), F.lit(0))
        begin = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))
        return F.aggregate(pieces, begin, step, lambda s: F.when(s["depth"] == 0, F.substring(rest, F.lit(1), s["size"] - 1)))

    return F.when(text.contains(marker), bind(F.substring_index(text, marker, -1), read))


def extract_last_boxed(text: str | Column, fallbacks: bool = False) -> Column:
    """Content of the last balanced ``\\boxed{...}``, null if there is none.

    With ``fallbacks``, text behind a last ``\\boxed `` up to a dollar sign wins,
    and a text without any box may use ``\\fbox{...}``.
    """
    t = col(text)
    if not fallbacks:
        return _content(t, "\\boxed")
    spaced = F.substring_index(F.substring_index(t, "\\boxed ", -1), "$", 1)
    return F.when(t.contains("\\boxed "), spaced).when(t.contains("\\boxed"), _content(t, "\\boxed")).otherwise(_content(t, "\\fbox"))


# ---------------------------------------------------------------- hash answers
def extract_hash_answer(text: str | Column, method: str = "strict") -> Column:
    """Answer in the last 300 characters: the number behind the last ``####``, or the last number at all."""
    t = tail(text, TAIL_CHARS)
    if method == "strict":
        found = last_item(findall(t, r"#### (-?[0-9.,]+)"))
        return swap(swap(found, ",", ""), "$", "")
    if method != "flexible":
        raise ValueError(f"unknown method {method!r}")
    numbers = findall(t, r"(-?[0-9.,]+)")
    real = F.filter(numbers, lambda x: (x != "") & (x != "."))
    return F.coalesce(last_item(real), F.try_element_at(numbers, F.lit(1)))


# ---------------------------------------------------------------- normal forms
def latex_normal(text: Column) -> Column:
    """Normal form of a LaTeX answer (``s``), and whether the rules apply to it at all (``ok``)."""

    def keep(s: Column, ok: Column) -> Column:
        return F.struct(s.alias("s"), ok.alias("ok"))

    def units(s: Column) -> Column:
        return keep(F.substring_index(s, "\\text{ ", 1), F.size(F.split(s, r"\\text\{ ")) <= 2)

    def percent(x: Column) -> Column:
        s = swap(swap(x["s"], "\\\\%", ""), "\\%", "")
        return keep(swap(swap(s, " .", " 0."), "{.", "{0."), x["ok"])

    def name(x: Column) -> Column:
        s = F.when(x["s"].startswith("."), F.concat(F.lit("0"), x["s"])).otherwise(x["s"])
        # a short name in front of the only equals sign goes
        return keep(F.regexp_replace(s, r"(?s)^[^=]{0,2}=([^=]*)$", "$1"), x["ok"])

    def roots(x: Column) -> Column:
        s = F.regexp_replace(x["s"], r"(?s)\\sqrt([^{])", r"\\sqrt{$1}")
        return keep(swap(s, " ", ""), x["ok"] & ~x["s"].rlike(r"\\sqrt($|\\sqrt)"))

    def fractions(x: Column) -> Column:
        s = x["s"]
        whole = F.regexp_replace(F.regexp_replace(s, r"\\frac([^{\\]|\\(?!frac))([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])\{", r"\\frac{$1}{")
        return keep(F.when(s.rlike(r"\\frac[^{]($|\\frac)"), s).otherwise(whole), x["ok"] & ~s.rlike(r"\\frac($|\\frac)"))

    def last(x: Column) -> Column:
        s = F.when(x["s"] == "0.5", F.lit("\\frac{1}{2}")).otherwise(x["s"])
        return keep(F.regexp_replace(s, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}"), x["ok"])

    s = text
    for piece in LATEX_REMOVED_FIRST:
        s = swap(s, piece, "")
    for old, new in LATEX_RENAMED:
        s = swap(s, old, new)
    for piece in LATEX_REMOVED:
        s = swap(s, piece, "")
    for stage in (units, percent, name, roots, fractions, last):
        s = bind(s, stage)
    return s


def latex_equal(a: Column, b: Column) -> Column:
    """Equal in normal form; compared as written when a rule cannot be applied to one of them."""
    both = F.struct(latex_normal(a).alias("x"), latex_normal(b).alias("y"), (a == b).alias("same"))
    return bind(both, lambda p: F.coalesce(F.when(p["x"]["ok"] & p["y"]["ok"], p["x"]["s"] == p["y"]["s"]).otherwise(p["same"]), F.lit(False)))


def final_answer_normal(text: Column) -> Column:
    """Normal form of a quantitative answer: wording, units and shorthand TeX taken off."""
    s = F.substring_index(text, "=", -1)
    for old, new in FINAL_ANSWER_SUBSTITUTIONS:
        s = swap(s, old, new)
    for piece in FINAL_ANSWER_REMOVED:
        s = swap(s, piece, "")
    s = F.regexp_replace(s, r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for macro in ("text", "textbf", "overline"):
        s = F.regexp_replace(s, rf"\\{macro}\{{(.*?)\}}", "$1")
    s = F.regexp_replace(s, r"\\boxed\{(.*)\}", "$1")
    s = F.regexp_replace(s, r"(?s)frac([^{])(.)", r"frac{$1}{$2}")
    s = F.regexp_replace(s, r"(?s)sqrt([^{])", r"sqrt{$1}")
    s = swap(s, "$", "")
    return strip(bind(s, lambda x: F.when(swap(x, ",", "").rlike(r"^[0-9]+$"), swap(x, ",", "")).otherwise(x)))


def qa_normal(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single blanks."""
    s = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    s = F.regexp_replace(s, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def last_answer_tag(text: str | Column) -> Column:
    """Trimmed text of the last complete ``<answer>...</answer>``, null if there is none."""
    return strip(last_item(findall(text, r"(?s)<answer>(.*?)</answer>")))


def count_of(text: str | Column, piece: str) -> Column:
    t = col(text)
    return ((F.length(t) - F.length(swap(t, piece, ""))) / len(piece)).cast("int")


# ---------------------------------------------------------------- code, tools, cuts
def extract_code_block(text: str | Column) -> Column:
    """Longest fenced block, the first of equals, null if there is none."""
    blocks = findall(text, r"(?s)```\w*\n(.*?)```")
    ranked = F.transform(blocks, lambda b, i: F.struct(F.length(b).alias("n"), (-i).alias("i"), b.alias("b")))
    return F.array_max(ranked)["b"]


def extract_tool_calls(text: str | Column, style: str = "tags") -> Column:
    """Struct of the text without tool calls and its calls ``(name, arguments)``; a call that is no JSON is skipped.

    ``tags`` reads ``<tool_call>{...}</tool_call>``; ``channel`` reads messages
    to ``functions.<name>`` after the analysis messages are taken off, and
    leaves checking of the arguments to the caller.
    """
    t = col(text)
    kind = "array<struct<name:string,arguments:string>>"
    if style == "tags":
        span = r"(?s)<tool_call>(.*?)</tool_call>"
        parsed = F.transform(findall(t, span), lambda j: F.from_json(j, "name string, arguments string", {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}))
        calls = F.filter(parsed, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())
    elif style == "channel":
        t = F.regexp_replace(t, r"(?s)<\|start\|>assistant<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "")
        t = F.regexp_replace(t, r"(?s)<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "")
        span = r"(?s)<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"
        calls = F.zip_with(findall(t, span, 1), findall(t, span, 2), lambda n, a: F.struct(n.alias("name"), a.alias("arguments")))
    else:
        raise ValueError(f"unknown style {style!r}")
    return F.struct(F.regexp_replace(t, span, "").alias("content"), calls.cast(kind).alias("calls"))


def truncate_text(text: str | Column, max_chars: int, side: str = "middle") -> Column:
    """Cut a long text: ``left`` keeps its head, ``right`` its tail, else both ends."""
    t, half = col(text), max_chars // 2
    cut = {
        "left": F.concat(F.left(t, F.lit(max_chars)), F.lit("...(truncated)")),
        "right": F.concat(F.lit("(truncated)..."), F.right(t, F.lit(max_chars))),
    }.get(side, F.concat(F.left(t, F.lit(half)), F.lit("...(truncated)..."), F.right(t, F.lit(half))))
    return F.when(F.length(t) > max_chars, cut).otherwise(t)
