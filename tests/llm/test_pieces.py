import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rollframe.llm import pieces, queries


def greedy(word, vocabulary):
    """Longest match by trying every prefix; 1 where the word can't be cut."""
    n = at = 0
    longest = max(map(len, vocabulary))
    while at < len(word):
        for size in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + size] in vocabulary:
                at, n = at + size, n + 1
                break
        else:
            return 1
    return n


def counted(automaton, words, lead=None):
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return automaton.count(data, np.r_[0, ends[:-1]], ends, lead).tolist()


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12), st.lists(st.text("abcd", min_size=1, max_size=90), min_size=1, max_size=8))
def test_counts_are_greedy(vocabulary, words):
    vocabulary, words = {v.encode() for v in vocabulary}, [w.encode() for w in words]
    automaton = pieces.PieceAutomaton(sorted(vocabulary))
    want = [greedy(w, vocabulary) for w in words]
    assert counted(automaton, words) == want
    assert [automaton.count_one(w, None) for w in words] == want


def test_query_against_greedy(spark, sf):
    vocabulary = set(pieces.byte_level_pieces(queries.tokenizer_file("byte_bpe_50k.json")))
    assert len(vocabulary) == 50_256 and all(bytes([b]) in vocabulary for b in range(256))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = {}
    for r in queries.op7_token_counts(spark, sf).collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (texts.pop(r["doc_id"]) or "").encode())
        for w in words:
            if w not in known:
                known[w] = greedy(b" " + w, vocabulary)
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(known[w] for w in words))
    assert not texts


def test_odd_rows(spark, odd_docs, no_docs):
    rows = pieces.count_pieces(odd_docs, [b" ", b"a", b" alpha", b"lpha"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["n_words"], r["n_tokens"]))
    assert by[1] == [(3, 3), (3, 3)] == [*by[None], (3, 3)] and by[2] == by[3] == by[4] == [(0, 0)]
    assert by[5][0][0] == 30_000
    assert pieces.count_pieces(no_docs, [b"a"]).collect() == []
    long = spark.createDataFrame([(1, "a" * 100_000)], "doc_id long, text string")
    assert pieces.count_pieces(long, [b"aa", b"a"], None).first()["n_tokens"] == 50_000
