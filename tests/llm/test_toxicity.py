import unicodedata
from itertools import product

import numpy as np
import pytest

from rollframe.llm import queries, toxicity
from rollframe.llm.toxicity import INSULT, NEGATION, OTHER, QUOTE, REPORT, TARGET, THREAT


def plain_labels(classes):
    """The grammar's rules, read off the whole clause instead of a state."""
    out = []
    for i, c in enumerate(classes):
        lately = lambda w, n: any(x == w for x in classes[max(0, i - n) : i])
        quoted = classes[: i + 1].count(QUOTE) % 2 == 1
        told, denied = REPORT in classes[: i + 1] or quoted, lately(NEGATION, 3)
        if c == TARGET and lately(THREAT, 4):
            # a later threat word starts the window again, so the nearest one decides
            out.append(5 if denied or told else 4)
        elif c == INSULT:
            out.append(3 if told else 2 if denied else 1 if lately(TARGET, 3) else 0)
        else:
            out.append(-1)
    return out


@pytest.mark.parametrize("length", [1, 2, 4])
def test_composed_machine_follows_the_rules(length):
    move, label = toxicity.grammar()
    for classes in product(range(7), repeat=length):
        state, got = 0, []
        for c in classes:
            got.append(label[state][c])
            state = move[state][c]
        assert got == plain_labels(classes), classes


def test_long_clauses_follow_the_rules():
    move, label = toxicity.grammar()
    rng = np.random.default_rng(0)
    for _ in range(300):
        classes = rng.integers(0, 7, 30).tolist()
        state, got = 0, []
        for c in classes:
            got.append(label[state][c])
            state = move[state][c]
        assert got == plain_labels(classes)


def lexicon(*words):
    return toxicity.Lexicon(50, 500, {w: (40, 0) for w in words}, 3.0)


@pytest.mark.parametrize("text, want", [
    ("you are an idiot", [1]), ("a fool and idiot", [0]), ("he is not an idiot", [2]), ("she said he is an idiot", [3]),
    ('the word "idiot" here', [3]), ("I will kill you", [4]), ("they said kill him", [5]), ("kill time. you", []), ("", []),
    ("never. idiot", [0]), ("said. idiot", [0]),
])
def test_circumstances(text, want):
    got = toxicity.matches(text.lower(), lexicon("idiot"), *toxicity.grammar())
    assert [which for clause in got for _, which, _ in clause] == want


def test_own_document_is_left_out():
    lex = toxicity.Lexicon(10, 100, {"w": (1, 0), "v": (2, 0)}, 1.0)
    assert lex.weight("w") > 0 and lex.weight("w", 1) == 0 and 0 < lex.weight("v", 1) < lex.weight("v")
    assert lex.insult("vvvvvvvv") == 0


def test_held_out_ranking(spark):
    """Clean and toxic documents differ by planted words; a decoy word is in both."""
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(1200):
        bad = i % 10 == 0
        words = [f"w{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in rng.integers(0, 600, 60)]
        if bad:
            for at in rng.integers(0, 60, 4):
                words[at] = ["zork", "blemp", "quix"][at % 3]
        if i % 7 == 0:
            words[5] = "decoy"
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, text string")
    model = toxicity.train(docs.where("crc32(CAST(doc_id AS STRING)) % 3 <> 1"), labels)
    got = toxicity.score(docs, model).where("crc32(CAST(doc_id AS STRING)) % 3 = 1").collect()
    bad, good = [r["score"] for r in got if r["doc_id"] % 10 == 0], [r["score"] for r in got if r["doc_id"] % 10]
    assert min(bad) >= 0.7 > max(good)


def test_labels_beyond_the_broadcast(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    small = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    large = toxicity.train(docs, labels)
    assert small.lexicon.counts == large.lexicon.counts and np.allclose(small.coefficients, large.coefficients)


@pytest.fixture(scope="module")
def open_vocabulary(spark):
    """60,000 words that stand in two toxic texts by chance, and an insult that clean texts also name."""
    by_chance = lambda i: " ".join(f"{chr(97 + i // 2)}{chr(97 + n // 676)}{chr(97 + n // 26 % 26)}{chr(97 + n % 26)}" for n in range(3000))
    rows = [(i, f"you zork. {by_chance(i)}", 1) for i in range(40)]
    rows += [(100 + i, "plain talk and no zork" if i < 30 else "plain talk", 0) for i in range(1400)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_chance_units_do_not_push_out_an_insult(open_vocabulary):
    model = toxicity.train(open_vocabulary.drop("toxic"), open_vocabulary)
    assert len(model.lexicon.counts) > 50_000 and model.lexicon.counts["zork"] == (40, 30)


def test_lexicon_beyond_the_broadcast(spark, sf, odd_docs, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    small = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "BROADCAST_UNITS", 0)
    large = toxicity.train(docs, labels)
    assert large.lexicon.counts == {} and large.units.count() >= len(small.lexicon.counts) > 0
    assert np.allclose(small.coefficients, large.coefficients)
    want, got = (sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.score(rows, m).collect()) for m in (small, large))
    assert [i for i, _ in want] == [i for i, _ in got] and np.allclose([x for _, x in want], [x for _, x in got])
    assert toxicity.with_score(odd_docs, large).columns == [*odd_docs.columns, "score"]
    assert toxicity.with_score(odd_docs, large).count() == odd_docs.count()


@pytest.mark.parametrize("word", ["मूर्ख", "cre\u0301tin", "crétin", "אִדְיוֹט", "โง่"])
def test_words_with_marks_are_learned_and_found(spark, word):
    rows = [(i, f"aa {word} bb", 1) for i in range(40)] + [(100 + i, "aa bb", 0) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs)
    forms = [unicodedata.normalize(f, f"cc {word}") for f in ("NFC", "NFD")]
    scored = toxicity.score(spark.createDataFrame([*enumerate(forms), (2, "cc")], "doc_id long, text string"), model)
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert got[0] == got[1] >= 0.7 > got[2]


def test_marks_are_those_of_the_jvm(spark):
    texts = ["a\u0301b c", "\u0915\u094d\u0937 x", "x\U0001e8d0y"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(r"regexp_extract_all(lower(t), '[\\p{L}\\p{M}]+', 0) AS w")
    assert [r["w"] for r in got.collect()] == [toxicity.TOKEN.findall(t.lower()) for t in texts]


def test_query(spark, sf):
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    first, again = (sorted(map(tuple, queries.op4_toxicity(spark, sf).collect())) for _ in range(2))
    assert first == again and [r[0] for r in first] == ids
    assert all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.7) for r in first)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (5, 0, "a"), (2, 1, "a"), (None, 1, "a"), (3, None, "a"), (8, 7, "a")], "doc_id long, toxic int, text string")
    model = toxicity.train(odd_docs, labels)
    got = {}
    for r in toxicity.score(odd_docs, model).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert len(got[1]) == 2 and len(got[None]) == 1 and got[2] == got[3] == got[4]
    nothing = toxicity.train(no_docs, labels)
    assert toxicity.score(no_docs, model).collect() == []
    assert all(0 <= r["score"] < 0.7 for r in toxicity.score(odd_docs, nothing).collect())


def test_other_words_do_nothing():
    assert toxicity.features("plain words only", lexicon(), *toxicity.grammar()) == [0.0] * toxicity.FEATURES
    assert plain_labels([OTHER]) == [-1]
