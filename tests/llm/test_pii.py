import hashlib
import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollframe.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        out += [(m.start(), k, m.end(), kind, m.group()) for m in re.finditer(pattern, text) if good(kind, m.group())]
    return sorted(out)


def written(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind, _ in spans)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select("doc_id", pii.written(pii.base_spans(F.col("text"))).alias("w")).collect()
    return [r["w"] for r in sorted(rows, key=lambda r: r["doc_id"])]


TEXTS = [
    "a@b.c_d@e.f x@a@b.c", "a@b.c.", "é@ß.de q%w+e@x-y.z--.q", "1.2.3.4.5.6.7.8.9", "300.1.1.1 001.02.3.255 1.1.1.256", "😀 10.0.0.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111--1111", "4111 1111 1111 1112", "79927398713000 00000000000000", "1" * 40,
    "+1 (555) 123-4567 x +49.30.1234567) +12", "+4111111111111111", "+1" + "(" * 300, "a." * 3000 + "@b", "a@" + "b." * 4000 + "c", "1 " * 5000,
    "", "0" * 3000 + ".0.0.0", "+1234567890 @ 5.5.5.5@c.d",
]


def test_base_spans_are_the_plain_ones(spark):
    assert found(spark, TEXTS) == [written(plain_spans(t)) for t in TEXTS]


def test_generated_texts(spark):
    seen = []

    @settings(max_examples=300, deadline=None)
    @given(st.text("a.@-+ 0149_%é(", max_size=60))
    def gather(t):
        seen.append(t)

    gather()
    assert found(spark, seen) == [written(plain_spans(t)) for t in seen]


WORD = re.compile(r"[^\W\d_]+")


def plain_terms(docs, share=0.8, support=2):
    """Brute force over {key: text}: the words to hide per key, from whole documents, at any distance and of any length."""
    spans = {k: plain_spans(t) for k, t in docs.items()}
    df, entities, pairs, own = Counter(), Counter(), Counter(), {}
    for k, t in docs.items():
        df.update(set(WORD.findall(t.lower())))
        outside = list(t)
        for a, _, b, _, _ in spans[k]:
            outside[a:b] = "|" * (b - a)
        ents = {(kind, value.lower()) for _, kind, _, _, value in spans[k]}
        own[k] = {(e, w) for e in ents for w in WORD.findall("".join(outside).lower())}
        entities.update(ents)
        pairs.update(own[k])
    tells = lambda e, w: pairs[e, w] >= support and 1 + math.log(min(1, pairs[e, w] / df[w])) / math.log(len(docs) / entities[e]) >= share
    return spans, {k: {w for e, w in own[k] if len(docs) > entities[e] and tells(e, w)} for k in docs}


def test_query_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    spans, terms = plain_terms(docs)
    rows = queries.op10_personal_data(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        base = spans[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        n = Counter(s[3] for s in base)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [n[k] for k in PLAIN]
        extra = []
        for m in WORD.finditer(docs[r["doc_id"]]):
            if m.group().lower() in terms[r["doc_id"]] and all(m.end() <= a or m.start() >= b for a, _, b, _, _ in base):
                extra.append((m.start(), 9, m.end(), "term", ""))
        assert r["spans"] == written(sorted([*base, *extra]))


@pytest.fixture(scope="module")
def telling(spark):
    rows = [(i, f"filler words {i} here", "x") for i in range(40)]
    rows += [(100 + i, f"The Zanzibar office of Bob: bob@corp.com, again ZANZIBAR. filler words {i}", "x") for i in range(3)]
    rows += [(200, "Call Bob@corp.com filler", "x"), (201, "zanzibar alone", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string")


def test_terms_that_tell(spark, telling):
    out = pii.find_personal_data(telling).select("doc_id", pii.written(F.col("spans")).alias("w"), pii.sanitised(F.col("text"), F.col("spans")).alias("t"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[100]["t"] == "    : [EMAIL],  . filler words 0"  # short words tell as well
    assert got[200]["t"] == "Call [EMAIL] filler" and got[201]["w"] == "" and got[201]["t"] == "zanzibar alone"


def test_terms_tell_in_the_whole_document(spark, telling):
    """A word that tells an entity goes wherever it stands in a document with the entity, and only there."""
    far = "filler words here " * 30
    more = spark.createDataFrame([(300, f"mail bob@corp.com {far}Zanzibar", "x"), (301, f"mail amy@corp.com {far}Zanz", "x")], telling.schema)
    rows = pii.find_personal_data(telling.union(more)).select("doc_id", pii.sanitised(F.col("text"), F.col("spans")).alias("t")).collect()
    got = {r["doc_id"]: r["t"] for r in rows}
    assert got[300] == f"mail [EMAIL] {far}" and got[301] == f"mail [EMAIL] {far}Zanz"
    assert got[201] == "zanzibar alone" and got[100].endswith(": [EMAIL],  . filler words 0")


def test_far_and_short_words_tell(spark):
    """A name that stands in both documents of an address and in no other, 360 characters away, and a name of three letters."""
    far = " ".join(f"filler{i}" for i in range(40))
    rows = [(i, f"{far} common {i}") for i in range(30)]
    rows += [(100 + i, f"ann@corp.com {far} Quillon") for i in range(2)] + [(200 + i, f"Kim {far} kim@corp.com") for i in range(3)]
    got = {r["doc_id"]: r["t"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc_id", pii.sanitised(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got[100] == f"[EMAIL] {far} " and got[201] == f" {far} [EMAIL]" and got[7] == rows[7][1]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = pii.find_personal_data(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["spans"] == [] for r in rows)
    assert pii.find_personal_data(no_docs).collect() == []


def test_no_python_runs(spark, telling):
    plan = pii.find_personal_data(telling)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
