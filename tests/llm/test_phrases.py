import re
from collections import Counter

import numpy as np
import pytest

from rollframe.llm import phrases


def brute_counts(rows, longest, least):
    counts = Counter()
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            if words:
                counts[lang or "und", "", 0] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", " ".join(words[i : i + k]), k] += 1
    return {key: n for key, n in counts.items() if n >= least or key[2] == 0}


def brute_collocations(counts, keep, longest):
    out = []
    for lang in {key[0] for key in counts}:
        f = {p: n for (g, p, k), n in counts.items() if g == lang and k}
        found = []
        for phrase, a in f.items():
            words = phrase.split(" ")
            if len(words) < 2:
                continue
            inside = any(
                5 * n >= 4 * a and any(longer.split(" ")[i : i + len(words)] == words for i in range(len(longer.split(" ")) - len(words) + 1))
                for longer, n in f.items() if len(longer.split(" ")) > len(words)
            )
            parts = [(f[" ".join(words[:k])], f[" ".join(words[k:])], k) for k in range(1, len(words))]
            score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for l, r, k in parts)
            if not inside:
                found.append((-score, -a, phrase.encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:keep], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, counts[lang, "", 0], -score))
    return sorted(out)


def texts():
    pick = np.random.default_rng(3)
    words = ["alpha", "Beta", "gamma", "été", "x", "漢字", "\xa0odd", "\x1cq", "k9"]
    rows = []
    for i in range(60):
        size = int(pick.integers(0, 60))
        rows.append((i, "".join(words[pick.integers(0, 9)] + [" ", " ", "  ", "\t", ", ", ".", "\n"][pick.integers(0, 7)] for _ in range(size)), ["en", "fr", None][i % 3]))
    hot = "new york city hall " * 400
    return rows + [(100, None, "en"), (101, "", None), (102, " \t.,", "de"), (None, "alpha Beta", None), (103, hot, "en"), (104, hot, "en"), (104, hot, "en")]


def counted(df):
    return {(r.lang, r.phrase, r.words): r.n for r in df.collect() if r.words or r.n}


@pytest.mark.parametrize("shards, bits, block_bytes", [(4, 24, 4 << 20), (3, 3, 64), (1, 16, 200)])
def test_counts_and_scores_are_those_of_all_texts(spark, shards, bits, block_bytes):
    """Whatever the shards, the cells of the map (a few shared by all) and the blocks a text is read in."""
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS shard", "2 AS n", "3 AS words").repartition(3)
    found = phrases.frequent_phrases(docs, 4, 5, shards, bits, block_bytes)
    want = brute_counts([(t, g) for _, t, g in rows], 4, 5)
    assert counted(found) == want
    if shards == 4:
        got = [tuple(r) for r in phrases.collocations(found, 20).collect()]
        assert sorted(got) == brute_collocations(want, 20, 4) and len(got) > 20


def test_a_word_of_more_than_a_block_and_a_longer_phrase(spark):
    rows = [(1, "a b c d e " * 6 + "z" * 300 + " a b c d e" * 6, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = phrases.frequent_phrases(docs, 5, 3, 2, 16, 50)
    assert counted(found) == brute_counts([("a b c d e " * 6 + "z" * 300 + " a b c d e" * 6, "en")], 5, 3)


def test_phrases_ending_late_are_activated_in_a_later_cycle(spark):
    """A word that reaches the threshold only in the last shard still gives its phrases a full cycle."""
    rows = [(i, "rare pair here", "en") for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = counted(phrases.frequent_phrases(docs, 3, 7, 4, 20))
    assert found == {("en", p, p.count(" ") + 1): 7 for p in ("rare", "pair", "here", "rare pair", "pair here", "rare pair here")} | {("en", "", 0): 21}


def test_no_overflow_and_exact_scores(spark):
    big = 9_000_000_000_000_000
    rows = [("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 1), ("en", "", 0, 3 * big)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, words int, n long")
    row = phrases.collocations(counts).first()
    assert row.score == 2_000_000 * (big - 1) // (2 * big + 1) and (row.a, row.l, row.r, row.n) == (big - 1, big, big + 1, 3 * big)


def test_empty_table(spark, no_docs):
    found = phrases.frequent_phrases(no_docs)
    assert found.count() == 0
    assert phrases.collocations(found).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and phrases.collocations(found).count() == 0


def test_odd_documents(spark, odd_docs):
    rows = [(r.text, r.lang) for r in odd_docs.select("text", "lang").collect()]
    assert counted(phrases.frequent_phrases(odd_docs, 3, 2)) == brute_counts(rows, 3, 2)


def test_lengths_whose_cycles_are_over_are_counted_no_more():
    """Cells that another phrase set later can't make a phrase of k words frequent after step k * shards - 1."""
    import zlib
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark import cloudpickle

    batch = pa.RecordBatch.from_arrays([pa.array(["a b c d e a b c d e\n"]), pa.array([5])], names=["text", "lang"])
    counted_at = {}
    for step in range(9):
        reached = np.full(1 << 15, max(0, step - 1), dtype=np.uint8)  # as if every cell had been reached in the step before
        sent = SimpleNamespace(value=cloudpickle.dumps(zlib.compress((reached if step else reached + phrases.NEVER).tobytes())))
        found = [b for b in phrases._count(step, 2, 4, 15, sent, 1 << 20)(iter([batch]))]
        counted_at[step] = sorted({c >> phrases.SINCE_BITS for b in found for c in b["code"].to_pylist()} - {0})
    assert counted_at == {0: [1], 1: [1, 2, 3, 4], 2: [2, 3, 4], 3: [2, 3, 4], 4: [3, 4], 5: [3, 4], 6: [4], 7: [4], 8: []}


@pytest.mark.parametrize("shards", [1, 2, 3])
@pytest.mark.parametrize("bits", [3, 24])
def test_counts_are_exact_on_a_crowded_map(spark, bits, shards):
    df = spark.createDataFrame(texts(), "doc_id long, text string, lang string")
    got = counted(phrases.frequent_phrases(df, 4, 8, shards=shards, bits=bits, block_bytes=64))
    assert got == brute_counts([r[1:] for r in texts()], 4, 8)
