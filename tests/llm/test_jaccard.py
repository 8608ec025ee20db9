import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollframe.llm import jaccard, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(UPPER))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def plain(docs, k, num, den):
    """Brute force: every pair of distinct sets, classes by search, smallest id per class."""
    sets = [shingles(t, k) for _, t in docs]
    nodes = {s: i for i, s in enumerate(sorted(set(sets), key=lambda s: sorted(s)))}
    label = list(range(len(nodes)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    where = {}
    for s in nodes:
        for t in s:
            where.setdefault(t, set()).add(s)
    seen = set()
    for group in where.values():
        for a, b in combinations(sorted(group, key=nodes.get), 2):
            if (a, b) not in seen:
                seen.add((a, b))
                if den * len(a & b) >= num * len(a | b):
                    label[find(nodes[b])] = find(nodes[a])
    least = {}
    for (d, _), s in zip(docs, sets):
        if s and d is not None:
            c = find(nodes[s])
            least[c] = min(least.get(c, d), d)
    return [(d, len(s), least.get(find(nodes[s])) if s else d) for (d, _), s in zip(docs, sets)]


def key(r):
    return (r[0] is None, r[0] or 0, r[1:2])


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=key)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 25), min_size=1), min_size=2, max_size=9, unique=True), st.sampled_from([50, 80, 90]))
def test_links_within_a_site(sets, num):
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    links = jaccard.links_within(arrays, num, 100)
    label = list(range(len(sets)))
    for a, b in links:
        assert 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and label[a] != label[b]
        label = [label[a] if x == label[b] else x for x in label]
    for a, b in combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            assert label[a] == label[b]


def copies(seed, n_docs, length, edits):
    """Random documents, and copies of some with a few words changed."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"W{i}" for i in range(300)]
    texts = [list(rng.choice(vocabulary, max(1, int(rng.integers(1, length))))) for _ in range(n_docs)]
    for _ in range(2 * n_docs):
        t = list(texts[int(rng.integers(0, len(texts)))])
        for at in rng.integers(0, len(t), int(rng.integers(0, edits))):
            t[int(at)] = str(rng.choice(vocabulary))
        texts.append(t)
    order = rng.permutation(len(texts))
    return [(int(d), " ".join(w if (i + d) % 3 else w.lower() for i, w in enumerate(t))) for d, t in zip(order, texts)]


@pytest.mark.parametrize("k, num, most", [(3, 90, 2048), (5, 80, 2048), (3, 80, 4), (1, 50, 6)])
def test_documents_against_brute_force(spark, monkeypatch, k, num, most):
    monkeypatch.setattr(jaccard, "SITE_MEMBERS", most)
    monkeypatch.setattr(jaccard, "SHARD_BYTES", 5000)
    docs = copies(k + num, 60, 120, 4)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = sorted(plain(docs, k, num, 100), key=key)
    assert got(jaccard.near_duplicates(df, k, num, 100)) == want
    assert len({c for _, _, c in want}) < len({shingles(t, k) for _, t in docs})


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op5_ngram_jaccard(spark, sf)) == sorted(plain(docs, 3, 90, 100), key=key)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(jaccard.near_duplicates(odd_docs)) == sorted(plain(docs, 5, 80, 100), key=key)
    assert jaccard.near_duplicates(no_docs).collect() == []


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(i, i + 1) for i in range(200, 260)] + [tuple(p) for p in rng.integers(0, 150, (90, 2)).tolist()] + [(-5, 149), (7, 7)]
    got = {r["node"]: r["label"] for r in jaccard.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {n: n for p in pairs for n in p}
    for _ in range(300):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: x for n, x in label.items() if n != x}
