import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollframe.llm import queries, substring

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain(docs, size):
    """Brute force over [(id, text)]: per row the number of words, the number removed, and what is kept."""
    words = [WORD.findall((t or "").encode()) for _, t in docs]
    first = {}
    for (d, _), own in zip(docs, words):
        for i in range(len(own) - size + 1):
            w = tuple(own[i : i + size])
            if d is not None:
                first[w] = min(first.get(w, d), d)
    out = []
    for (d, _), own in zip(docs, words):
        gone = [False] * len(own)
        for i in range(len(own) - size + 1):
            if d is not None and first[tuple(own[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append((d, len(own), sum(gone), b" ".join(w for w, g in zip(own, gone) if not g).decode()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


def got(df):
    return sorted(map(tuple, df.collect()), key=key)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.lists(st.sampled_from("abc"), min_size=3, max_size=14)), max_size=8))
def test_repeated_windows(pieces):
    pieces = sorted(((d, " ".join(w).encode()) for d, w in pieces), key=lambda p: p[0])
    first = {}
    for d, raw in pieces:
        w = raw.split()
        for i in range(len(w) - 2):
            first.setdefault(tuple(w[i : i + 3]), d)
    want = [[i for i in range(len(r.split()) - 2) if first[tuple(r.split()[i : i + 3])] < d] for d, r in pieces]
    assert substring.repeated_windows(pieces, 3) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), min_size=1, max_size=20), min_size=1, max_size=6), st.lists(st.sampled_from("ab"), max_size=30))
def test_automaton_knows_first_documents(texts, probe):
    a = substring.SuffixAutomaton()
    for d, t in enumerate(texts):
        a.add(t, d)
    for size in (1, 2, 5):
        want = []
        for i in range(len(probe) - size + 1):
            where = [d for d, t in enumerate(texts) if any(t[j : j + size] == probe[i : i + size] for j in range(len(t) - size + 1))]
            if where and where[0] < 3:
                want.append(i)
        assert a.windows_before(probe, 3, size) == want


@pytest.mark.parametrize("size, hot", [(13, 2000), (6, 2000), (6, 2), (5, 0)])
def test_documents_against_brute_force(spark, monkeypatch, size, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD_BYTES", 3000)
    rng = np.random.default_rng(size + hot)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choice(vocabulary, rng.integers(4, 30))) for _ in range(12)]
    docs = []
    for d in rng.permutation(150).tolist():
        parts = [str(rng.choice(passages)) if rng.random() < 0.5 else " ".join(rng.choice(vocabulary, 8)) for _ in range(rng.integers(0, 6))]
        docs.append((d, "\n ".join(parts)))
    docs += docs[:10] + [(d, docs[0][1]) for d in range(200, 220)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert got(substring.remove_repeats(df, size, min(5, size - 2))) == sorted(plain(docs, size), key=key)


class Hashes:
    """Words of one text, given by their hashes alone."""

    def __init__(self, hashes):
        self.hashes, self.bounds = hashes, np.array([0, len(hashes)])

    grams = substring.Words.grams


def test_anchors_of_equal_windows_in_a_text_of_many_words(monkeypatch):
    """Two equal passages 17 million words apart have their anchors at the same place of each window."""
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, (1 << 24) + 300_000, dtype=np.uint64)
    near, far = 1000, (1 << 24) + 200_000
    hashes[far : far + 60] = hashes[near : near + 60]
    _, starts, place = substring.anchors(Hashes(hashes), 13, 5)
    assert len(starts) == len(hashes) - 12 and (place >= starts).all() and (place <= starts + 8).all()
    assert (place[near : near + 48] - near).tolist() == (place[far : far + 48] - far).tolist()
    some = Hashes(np.repeat(hashes[:3000], 2) % np.uint64(50))  # many equal hashes: the leftmost counts in any stretch
    whole = substring.anchors(some, 13, 5)[2]
    monkeypatch.setattr(substring, "STRETCH", 17)
    assert substring.anchors(some, 13, 5)[2].tolist() == whole.tolist()


def test_documents_in_short_stretches(spark, monkeypatch):
    monkeypatch.setattr(substring, "STRETCH", 7)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(1, passage), (2, " ".join(f"x{i % 90}" for i in range(500)) + " " + passage), (3, passage + " end")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(substring.remove_repeats(df)) == sorted(plain(docs, 13), key=key)


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in plain(docs, 13))
    assert got(queries.op1_substring_dedup(spark, sf)) == want and sum(r[2] for r in want) > 0


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(substring.remove_repeats(odd_docs)) == sorted(plain(docs, 13), key=key)
    assert substring.remove_repeats(no_docs).collect() == []


def test_texts_are_shuffled_once(spark, sf):
    df = queries.op1_substring_dedup(spark, sf)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
