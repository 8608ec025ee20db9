from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from rollframe.llm import langid, queries


def test_held_out_accuracy(spark, sf):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_language(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(langs)
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_counts_are_those_of_plain_strings():
    texts = ["Ab a", "", "ÉÉ"]
    grams, bounds = langid._features(texts, 16, (1, 2))
    sizes = [len(f" {t} ") for t in texts]
    assert [b - a for a, b in zip(bounds, bounds[1:])] == [n + n - 1 for n in sizes]
    alone = [langid._features([t], 16, (1, 2))[0].tolist() for t in texts]
    assert grams.tolist() == sum(alone, [])
    assert langid._features(["aa"], 16, (1,))[0][1] == langid._features(["aa"], 16, (1,))[0][2]


def test_long_texts_outweigh_the_priors():
    """Two related languages, one of them rare: the whole text decides, and the score stays tempered and highest for it."""
    import pyarrow as pa
    from pyspark import cloudpickle

    grams = langid._features(["ab"], 16, (1,))[0]
    matrix = np.full((2, 1 << 16), -9.0)
    matrix[0, grams], matrix[1, grams] = -1.1, -1.0
    model = langid.LanguageModel(["hot", "rare"], np.log([0.999, 0.001]), matrix, 16, (1,))
    sent = SimpleNamespace(value=cloudpickle.dumps(model))
    texts = ["ab" * n for n in (2, 20, 5000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": texts})
    out = next(langid._score(sent, 60.0)([batch])).to_pydict()
    assert out["lang_pred"] == ["hot", "hot", "rare"] and all(0.5 <= s < 0.9999 for s in out["score"])


def test_partitions_do_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = langid.train(docs.coalesce(1)), langid.train(docs.repartition(7))
    assert one.langs == many.langs and (one.matrix == many.matrix).all() and (one.priors == many.priors).all()


def test_odd_rows(spark, odd_docs, no_docs):
    model = langid.train(odd_docs)
    assert model.langs == ["en", "fr"]
    rows = {}
    for r in langid.identify(odd_docs, model).collect():
        rows.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert len(rows[1]) == 2 and rows[1][0] == rows[1][1] and len(rows[None]) == 1
    assert rows[2] == rows[3] == rows[4] == rows[7] == [("und", 0.0)]
    assert rows[5][0][0] in ("en", "fr")
    nothing = langid.train(no_docs)
    assert nothing.langs == [] and langid.identify(no_docs, model).collect() == []
    assert {r["lang_pred"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}


def test_fold_is_crc32_of_the_text(spark):
    import zlib

    got = spark.range(50).select("id", langid.fold("id", 4).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in got)
    assert spark.sql("SELECT CAST(NULL AS LONG) AS id").select(F.coalesce(langid.fold("id", 4) == 2, F.lit(False))).first()[0] is False
