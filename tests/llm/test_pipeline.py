from collections import Counter, defaultdict

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from rollframe.llm import pii
from test_jaccard import plain as plain_classes
from test_mixing import WORD, targets
from test_packing import check_sequences, encoded


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage returns, from documents on, cached."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf).cache()
        out[name] = docs
    return out


def rows(df):
    return [tuple(r[c] for c in cp.COLUMNS) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_copies", "personal_data", "mixing", "packing"]
    for name, _ in cp.STAGES[:-1]:
        assert stages[name].columns == cp.COLUMNS
        assert [f.dataType for f in stages[name].schema] == [f.dataType for f in stages["documents"].schema]


def test_toxicity_only_drops(stages):
    before, after = Counter(rows(stages["documents"])), Counter(rows(stages["toxicity"]))
    assert after <= before and sum(after.values()) >= 0.8 * sum(before.values())


def test_one_of_each_class_stays(stages):
    docs = [(r["doc_id"], r["text"]) for r in stages["toxicity"].collect()]
    want = [d for d, n, c in plain_classes(docs, 5, 80, 100) if d == c]
    assert sorted(r["doc_id"] for r in stages["near_copies"].collect()) == sorted(want)


def test_no_personal_data_is_left(stages):
    before = {r["doc_id"]: r for r in stages["near_copies"].collect()}
    for r in stages["personal_data"].select("*", pii.base_spans(F.col("text")).alias("s")).collect():
        old = before.pop(r["doc_id"])
        assert r["s"] == [] and (r["lang"], r["source"], r["n_chars"]) == (old["lang"], old["source"], len(r["text"]))
        assert r["text"] == old["text"] or "[" in r["text"]
    assert not before


def test_sources_near_their_targets(stages):
    given, taken = defaultdict(int), defaultdict(int)
    longest = defaultdict(int)
    for r in stages["personal_data"].collect():
        n = len(WORD.findall(r["text"]))
        given[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    once = Counter(rows(stages["mixing"]))
    known = set(rows(stages["personal_data"]))
    assert set(once) <= known and max(once.values()) <= 3
    for row, n in once.items():
        taken[row[3]] += n * len(WORD.findall(row[1]))
    for s, t in targets(given).items():
        assert abs(taken[s] - t) <= longest[s]


def test_sequences_hold_the_mix(stages):
    packed = stages["packing"].collect()
    check_sequences(packed)
    want = Counter()
    for r in stages["mixing"].collect():
        want[r["doc_id"]] += len(encoded(r["text"]))
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_run_is_the_stages_in_a_row(spark, sf, stages):
    got = cp.run(spark, sf)
    assert got.columns == stages["packing"].columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, stages["packing"].collect()))
    assert cp.ORACLE_SQL is None


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 0, 1)], "doc_id long, toxic int, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for given in (odd_docs, no_docs):
        docs = given.withColumn("n_chars", F.length("text").cast("long"))
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, str(tmp_path)).cache()
            if given is no_docs:
                assert docs.count() == 0
        assert given is no_docs or docs.count() > 0
