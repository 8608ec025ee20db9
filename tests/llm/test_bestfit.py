import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rollframe.llm import bestfit
from rollframe.llm.common import Powers
from rollframe.llm.queries import op11_best_fit, tokenizer_file

FILE = "byte_bpe_50k.json"


def least(sizes, capacity):
    """The fewest bins, by trying every place for every size."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for at in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
            rooms[at] -= sizes[i]
            go(i + 1, rooms)
            rooms[at] += sizes[i]
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_as_few_bins_as_possible_for_small_inputs():
    pick = random.Random(4)
    for number in range(300):
        capacity = pick.randint(15, 60)
        low, high = (1, capacity) if number % 2 else (capacity // 6 + 1, capacity // 2)
        sizes = [pick.randint(low, high) for _ in range(pick.randint(1, 10))]
        bins = bestfit.bin_completion(Counter(sizes), capacity)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= capacity for b in bins)
        fewest = least(sizes, capacity)
        assert bestfit.least_bins(Counter(sizes), capacity) <= fewest == len(bins), (capacity, sizes)


@pytest.mark.parametrize("low, high", [(1, 2048), (600, 760), (300, 1100), (1, 40), (2048, 2048)])
def test_many_pieces(low, high):
    """Never more bins than best fit; with sizes around a third, where best fit is poor, nearly the least."""
    sizes = Counter(np.random.default_rng(7).integers(low, high + 1, 4096).tolist())
    bins, best_fit = bestfit.bin_completion(sizes), bestfit.best_fit_decreasing(sizes, 2048)
    assert Counter(s for b in bins for s in b) == sizes and all(sum(b) <= 2048 for b in bins)
    bound = bestfit.least_bins(sizes, 2048)
    assert bound <= len(bins) <= len(best_fit)
    if (low, high) == (600, 760):
        assert len(bins) <= 1.01 * bound < 0.95 * len(best_fit)


def test_best_fit_takes_the_fullest_bin():
    assert sorted(map(sorted, bestfit.best_fit_decreasing(Counter([7, 5, 3, 2]), 10))) == [[2, 5], [3, 7]]


def test_fillings_are_undominated_and_rise_in_waste():
    pool = bestfit.Pool(Counter([9, 6, 5, 4, 2]), 20)
    got = list(pool.fillings(10, 10))
    assert got[0][1] == 0 and {tuple(sorted(f)) for f, w in got if w == 0} == {(4, 6)}  # (5, ...) can't make 10 without it
    assert [w for _, w in got] == sorted(w for _, w in got)
    for filling, waste in got:  # nothing unused fits into what is left
        unused = [s for s in [9, 6, 5, 4, 2] if s not in filling]
        assert sum(filling) + waste == 10 and all(s > waste for s in unused)


def test_tokens_are_those_of_the_whole_text():
    from tokenizers import Tokenizer

    pick, parts = random.Random(2), [" ", "  ", "\n", "\t", " ", "a", "Bc", "é", "漢", "1", "9x", "'s", "'", "!", "...", ",", "<|endoftext|>", "\x1c", "\x85", "　", "\xa0", "😀", "​", "\r\n", "can't"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 40))) for _ in range(3000)]
    want = [e.ids for e in Tokenizer.from_file(tokenizer_file(FILE)).encode_batch(texts, add_special_tokens=False)]
    for keep, limit in ((1 << 20, 1 << 20), (50, 30)):  # few segments kept, texts read in parts
        got = dict(bestfit.token_runs(pa.array(texts), bestfit.SegmentIds(tokenizer_file(FILE), keep), Powers(), limit))
        assert [got[i].tolist() for i in range(len(texts))] == want


def test_pieces():
    assert bestfit.pieces(5, 8) == [(0, 5)] and bestfit.pieces(8, 8) == [(0, 8)]
    assert bestfit.pieces(9, 8) == [(0, 1), (1, 8)] and bestfit.pieces(16, 8) == [(0, 8), (8, 8)]


def check(rows, docs, capacity, end_id):
    """Every token of every document once, in its pieces, gapless in sequences that hold ``capacity`` at most."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file(FILE))
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id], dtype="<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, piece, a, b - a, ids[a:b].tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_documents(spark, odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    for group_pieces, block_bytes in ((4096, 1 << 20), (3, 500)):
        rows = bestfit.pack_best_fit(odd_docs, tokenizer_file(FILE), group_pieces=group_pieces, block_bytes=block_bytes).collect()
        sequences = check(rows, docs, 2048, 0)
        if group_pieces == 4096:
            assert sequences == -(-sum(r.length for r in rows) // 2048)


def test_equal_rows_are_spread_over_groups(spark):
    docs = spark.createDataFrame([(1, "same text here")] * 600, "doc_id long, text string").repartition(3)
    rows = bestfit.pack_best_fit(docs, tokenizer_file(FILE), capacity=32, group_pieces=50).collect()
    groups = Counter(r.sequence_id >> 32 for r in rows)
    assert sum(groups.values()) == 600 and max(groups.values()) < 100


def test_empty_table(spark, no_docs):
    assert bestfit.pack_best_fit(no_docs, tokenizer_file(FILE)).count() == 0


def test_query(spark, sf):
    rows = op11_best_fit(spark, sf).collect()
    assert set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= 1.001 * sum(filled.values()) / 2048 + 1
