"""Personal data: patterns for what is protected, and corpus statistics for the words that give it away.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import row_key

# The kinds in their order, and their patterns.  Quantifiers that never need to give back are possessive,
# and an attempt starts only where a match can begin, so a search is linear in the text; the matches are those of
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+        ip   [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+ with 14 digits or more             phone \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
TERM = len(KINDS) + 1
BYTE = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
WORD = r"(?<=[^\p{L}\p{M}])\p{L}[\p{L}\p{M}]*(?=[^\p{L}\p{M}])"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the check sum: every second from the right is doubled and its digits added."""
    d = F.reverse(digits(value))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return n.between(14, 19) & luhn(value)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def occurrences(text: Column, pattern: Column, kind: int) -> Column:
    """All matches from left to right as (start, kind, end, value), in code points.

    The text between the matches and the matches themselves alternate, so
    running sums of their lengths are the positions.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(state["spans"], span).alias("spans"))

    return F.aggregate(pairs, start, add, lambda s: s["spans"])


def only_valid(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: valid(kind, s["value"]))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == KINDS.index(kind) + 1)


def base_spans(text: Column) -> Column:
    """The valid matches of every kind, by start and kind."""
    none = F.array().cast(SPAN)
    each = []
    for number, kind in enumerate(KINDS, 1):
        pattern = F.lit(PATTERNS[kind])
        found = only_valid(occurrences(text, pattern, number), kind)
        each.append(F.when(text.rlike(PATTERNS[kind]), found).otherwise(none))
    return F.array_sort(F.concat(*each))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"], s["end"])), ",")


def _words(text: Column) -> Column:
    """The distinct words of a text in lower case: a letter with the letters and marks after it."""
    padded = F.lower(F.concat(F.lit(" "), text, F.lit(" ")))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(WORD), F.lit(0)))


def disclosing_terms(found: DataFrame, docs: DataFrame, least_share: float = 0.8, least_support: int = 2) -> DataFrame:
    """Which words of a document tell too much about a protected entity in it: row_key, terms.

    An entity is a kind with a value; ``docs`` counts (row_key, text), ``found``
    has row_key, text and spans of the rows with entities.  From whole documents
    counted over the whole corpus, a word's disclosure of an entity is their
    pointwise mutual information over the entity's information content,
    1 + log p(entity | word) / -log p(entity): 1 where every document with the
    word has the entity.  Words of any length, at any distance from the entity
    and outside all base spans, that share ``least_support`` documents or more
    with it and have at least ``least_share`` are returned for every row that
    holds the entity and the word.

    A word whose documents are too many for the share even if all those of the
    entity had it is dropped before pairs are counted, and so is one that
    stands in fewer documents than the support.
    """
    one = F.explode("spans").alias("s")
    entity = F.xxhash64("s.kind", F.lower("s.value")).alias("entity")
    holds = found.select("row_key", one).select("row_key", entity).distinct()
    with_entity = holds.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= least_support)
    total = docs.agg(F.count(F.lit(1)).cast("double")).scalar()
    content = F.log(total / F.col("n_entity"))
    # share >= least_share where n_both / n_term >= exp((least_share - 1) * content), and n_both <= n_entity
    most = F.floor(F.col("n_entity") * F.exp((1 - least_share) * content) + 1e-6)
    holds = cut(holds.join(with_entity.withColumn("most", most).where(content > 0), "entity"))
    with_term = docs.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    with_term = with_term.where(F.col("n_term").between(least_support, holds.agg(F.max("most")).scalar()))
    outside = sanitised(F.col("text"), F.col("spans"), F.lit(" | "))
    has = found.join(holds.select("row_key").distinct(), "row_key", "left_semi").select("row_key", F.explode(_words(outside)).alias("term"))
    held = has.join(with_term, "term").join(holds, "row_key").where(F.col("n_term") <= F.col("most"))
    held = cut(held.select("row_key", "entity", "term", "n_term", "n_entity"))
    both = held.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    share = 1 + F.log(F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))) / content
    telling = both.where((F.col("n_both") >= least_support) & (share >= least_share)).select("entity", "term")
    return held.join(telling, ["entity", "term"]).groupBy("row_key").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def find_personal_data(
    docs: DataFrame, least_share: float = 0.8, least_support: int = 2, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Base and term spans of each row of ``docs`` (doc_id, text): doc_id, row_key, text, base, spans, and the columns in ``keep``.

    Base spans are valid pattern matches, leftmost and non-overlapping within
    their kind.  Term spans are all occurrences, as whole words and outside
    base spans, of the words that disclose an entity of the row.

    A null text counts as empty and has no spans; repeated rows have equal
    spans and count as one document in the statistics; an empty table gives no
    rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    rows = rows.withColumn("row_key", row_key("doc_id", "text"))
    spans = rows.select("row_key", base_spans(F.col("text")).alias("spans"), "text")
    found = cut(spans.where(F.size("spans") > 0).dropDuplicates(["row_key"]))
    terms = disclosing_terms(found, rows, least_share, least_support)
    extra = found.select("row_key", "spans").join(terms, "row_key", "left")
    out = rows.join(extra, "row_key", "left")
    base = F.coalesce("spans", F.array().cast(SPAN))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{M}])"))
    hits = occurrences(F.col("text"), pattern, TERM)
    free = F.filter(hits, lambda h: ~F.exists(base, lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"])))
    every = F.when(F.col("terms").isNull(), base).otherwise(F.array_sort(F.concat(base, free)))
    return out.select("doc_id", "row_key", "text", base.alias("base"), every.alias("spans"), *keep)


def sanitised(text: Column, spans: Column, name: Column | None = None) -> Column:
    """The text with base spans generalised to their kind (or ``name``) and disclosing terms removed; overlapping spans go as one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") if name is None else name for k in KINDS], F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(F.lit(0), s["start"] - state["at"]))
        label = F.when(s["start"] >= state["at"], F.element_at(names, s["kind"])).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap, label).alias("out"))

    done = F.aggregate(spans, start, add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def counts(base: Column) -> list[Column]:
    """n_email, n_ip, n_card and n_phone of base spans."""
    return [F.size(of_kind(base, k)).cast("long").alias(f"n_{k}") for k in KINDS]
