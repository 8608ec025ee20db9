import re
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from compare import compare, duck
from rollframe.functions.groups import with_slot
from rollframe.llm import mixing, queries
from rollframe.llm.common import row_key, uniform

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(1, 2, 3), most=3):
    """Plain water filling: share out, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        now = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if now[s] > most * sizes[s]]
        if not over:
            return fixed | now
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 1, "b": 1000, "c": 10, "d": 5}, {"a": 100, "b": 1, "c": 1, None: 1}, {"a": 7}, {"a": 0, "b": 5}, {"Z": 3, "a": 4, "é": 1, "\U0001F600": 900, "￮": 2},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


def check(rows, docs):
    words = defaultdict(int)
    for r in docs:
        words[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = targets(words)
    taken = defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == words[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    assert len(rows) == len(docs)


def test_words_near_target_and_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix_sources(docs).collect()
    check(rows, docs.collect())
    few = mixing.mix_sources(docs.repartition(5), slots=3).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in few)


def test_better_documents_come_earlier(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'a b' AS text", "CAST(id % 2 AS STRING) AS source", "id % 20 < 10 AS good")
    rows = mixing.mix_sources(docs, quality=mixing.F.expr("if(doc_id % 20 < 10, 4.0, 1.0)")).where("source = '0' AND extra > 0")
    share = rows.selectExpr("avg(IF(doc_id % 20 < 10, 1, 0))").first()[0]
    assert share > 0.6


def test_odd_rows(spark, odd_docs, no_docs):
    check(mixing.mix_sources(odd_docs).collect(), odd_docs.collect())
    assert mixing.mix_sources(no_docs).collect() == []


def test_sql(spark, sf):
    line, good = compare(spark, duck(sf), "op8", queries.op8_mixing, queries.SQL["op8_mixing"], sf)
    assert good, line


def test_slots_are_even_for_texts_of_low_quality(spark):
    """A source of digits alone, with null ids among them: no range of the key holds one part in a hundred."""
    rows = [(None if i % 3 == 0 else i, f"{i} 17 4", "numbers") for i in range(20_000)] + [(i, "plain words here", "prose") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    narrow = docs.select((-F.ln(uniform("doc_id")) / mixing.text_quality()).alias("_key"), row_key("doc_id", "text").alias("row_key"))
    slots = with_slot(narrow.withColumn("_order", F.struct("_key", "row_key")), "_order", "_slot", mixing.SLOTS).groupBy("_slot").count()
    assert slots.agg(F.max("count")).first()[0] < 201 and slots.count() > 200
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 20_100 and {r["source"]: r["source_size"] for r in rows} == {"numbers": 60_000, "prose": 300}
    taken = defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
    assert taken == {r["source"]: int(r["target"]) for r in rows}
