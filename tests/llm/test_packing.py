import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollframe.llm import packing, queries


def encoded(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    return tok.encode(text or "", add_special_tokens=False).ids + [1]


def check_sequences(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return {k: sum(n for _, n in v) for k, v in by.items()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 150), max_size=60), st.sampled_from([8, 32]), st.integers(1, 5))
def test_group_holds_every_token_once(lengths, capacity, gap):
    seen = defaultdict(list)
    sizes = []
    for sequence in packing.pack_group(lengths, capacity, gap):
        sizes.append(sum(n for _, _, n in sequence))
        for d, s, n in sequence:
            assert n > 0
            seen[d].append((s, n))
    assert all(0 < n <= capacity for n in sizes)
    assert all(n + gap > capacity or n & (n - 1) == 0 for n in sizes)
    for d, n in enumerate(lengths):
        at = 0
        for s, m in sorted(seen[d]):
            assert s == at
            at += m
        assert at == n


@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
def test_first_fit_decreasing_is_the_plain_rule(sizes):
    room, plain = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        for b, r in enumerate(room):
            if r >= sizes[i]:
                break
        else:
            b = len(room)
            room.append(50)
            plain.append([])
        room[b] -= sizes[i]
        plain[b].append(i)
    assert packing.first_fit_decreasing(sizes, 50) == plain


def test_query_against_the_tokenizer(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_packing(spark, sf).collect()
    sizes = check_sequences(rows)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        ids, at = encoded(texts[d]), 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes.values())
    assert padding <= 0.01 * sum(sizes.values())


def test_odd_rows(spark, odd_docs, no_docs):
    vocabulary = queries.tokenizer_file("word_bpe_49k.json")
    rows = packing.pack_documents(odd_docs, vocabulary, group_docs=3).collect()
    check_sequences(rows)
    ids = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert ids[2] == ids[3] == ids[4] == 1 and ids[None] == len(encoded("alpha beta gamma"))
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 2 * ids[None]
    assert sum(r["length"] for r in rows) == sum(len(encoded(r["text"])) for r in odd_docs.collect())
    assert packing.pack_documents(no_docs, vocabulary).collect() == []


@pytest.mark.parametrize("text", ["<|endoftext|> a<|startoftext|>b", "İstanbul ΣΑΣ ’s don't", "á é  x\x1cy", "漢字 😀‍👩 ́a", "a., b,. ʼn, it's. ..., x.y, ½. ²,"])
def test_words_are_encoded_alike(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = packing.pack_documents(docs, queries.tokenizer_file("word_bpe_49k.json")).orderBy("start").collect()
    assert np.frombuffer(b"".join(bytes(r["ids"]) for r in got), dtype="<u4").tolist() == encoded(text)


def test_groups_are_bounded_by_bytes_and_equal_rows_spread(spark):
    long = spark.createDataFrame([(i, "word " * 4000) for i in range(40)], "doc_id long, text string")
    rows = packing.pack_documents(long, queries.tokenizer_file("word_bpe_49k.json"), group_bytes=100_000).collect()
    assert len({r["sequence_id"] >> 32 for r in rows}) > 4 and sum(r["length"] for r in rows) == 40 * 4001
    same = spark.createDataFrame([(1, "same text here")] * 600, "doc_id long, text string").repartition(3)
    rows = packing.pack_documents(same, queries.tokenizer_file("word_bpe_49k.json"), group_docs=50).collect()
    groups = {}
    for r in rows:
        groups[r["sequence_id"] >> 32] = groups.get(r["sequence_id"] >> 32, 0) + r["length"]
    assert sum(groups.values()) == 600 * 4 and max(groups.values()) < 100 * 4
