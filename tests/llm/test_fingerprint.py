import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollframe.llm import fingerprint as fp
from rollframe.llm import queries
from rollframe.llm.common import Powers

POWERS = Powers()


def plain_features(raw):
    """Window starts by the definition: entropies one by one, neighbourhood by neighbourhood."""
    if len(raw) < fp.WINDOW:
        return [0] if raw else []
    ranks = []
    for i in range(len(raw) - fp.WINDOW + 1):
        count = np.bincount(np.frombuffer(raw[i : i + fp.WINDOW], dtype=np.uint8))
        terms = sum(int(fp._TERM[c]) for c in count)
        ranks.append((-abs(terms - round(fp.WINDOW * (6 - fp.TYPICAL) * 2**20)), i))
    marks = {}
    for s in range(len(ranks) - fp.WINDOW + 1):
        least = min(ranks[s : s + fp.WINDOW])[1]
        marks[least] = marks.get(least, 0) + 1
    return sorted(i for i, n in marks.items() if n >= fp.POPULAR) or [min(ranks)[1]]


texts = st.lists(st.one_of(st.text("ab cé", max_size=400), st.text(max_size=90)), max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_features_of_texts_in_a_row(parts):
    raw = [t.encode("utf-8", "surrogatepass") for t in parts]
    offsets = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    got, owner = fp.features(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, POWERS)
    want = [(i, len(plain_features(r))) for i, r in enumerate(raw) if r]
    assert [(i, int((owner == i).sum())) for i, _ in want] == want and len(owner) == sum(n for _, n in want)
    alone = [fp.fingerprints([t], POWERS)[0] for t in parts]
    assert fp.fingerprints(parts, POWERS) == alone


def test_long_texts_give_the_same_in_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    raw = bytes(rng.choice(np.frombuffer(b"etaoin shrdlu,.", dtype=np.uint8), 700_000))
    whole, _ = fp.features(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), POWERS)
    blocks, _ = fp._long_features(raw, POWERS)
    assert whole.tolist() == blocks.tolist()


@pytest.mark.parametrize("period", ["a", "ab", "abcdefgh"])
def test_texts_without_a_marked_window_on_both_sides_of_the_block_limit(period):
    """A short period has no window that is rarer than its neighbours 16 times: the rarest one stands for the text at every length."""
    repeat = lambda n: (period * (n // len(period) + 1))[:n]
    prints = fp.fingerprints([repeat(n) for n in (1000, (1 << 20) - 1, 1 << 20, (1 << 21) + 5)], POWERS)
    assert len(set(prints)) == 1 and prints[0] != b""
    other = fp.fingerprints(["xyz" * 400_000], POWERS)[0]
    assert fp.likeness(other, prints[2]) == 0.0 == fp.likeness(other, b"")


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(n))


def test_likeness_follows_what_is_shared():
    a, b = words(1, 900), words(2, 900)
    half = a[: len(a) // 2] + b[len(b) // 2 :]
    pa_, pb, ph = fp.fingerprints([a, b, half], POWERS)
    assert fp.likeness(pa_, pa_) == 1 and fp.likeness(pa_, pb) < 0.1 and 0.3 < fp.likeness(pa_, ph) < 0.7
    assert fp.likeness(pa_, ph) == fp.likeness(ph, pa_)
    assert fp.likeness(b"", b"") == 1.0 and fp.likeness(b"", pa_) == 0.0


def check(rows, docs):
    """Rows against a plain walk over the documents by falling id."""
    order = sorted(docs, key=lambda d: -d[0])
    follow = {d: t or "" for (d, _), (_, t) in zip(order, order[1:] + order[:1])}
    text = {d: t or "" for d, t in docs}
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs) and set(got) == set(text)
    for d, t in text.items():
        edited = fp.edit(t, follow[d])
        a, b, c = fp.fingerprints([t, edited, follow[d]], POWERS)
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a.hex(), b.hex())
        assert (r["near_edited"], r["near_next"]) == (fp.likeness(a, b), fp.likeness(a, c))


@pytest.mark.parametrize("bucket", [32 << 20, 10_000])
def test_query_against_a_plain_walk(spark, sf, monkeypatch, bucket):
    monkeypatch.setattr(fp, "BUCKET_BYTES", bucket)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(queries.op6_fingerprints(spark, sf).collect(), docs)


def test_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    assert fp.compare_neighbours(no_docs).collect() == [] == fp.fingerprint(no_docs).collect()
    for bucket in (1 << 20, 100):
        monkeypatch.setattr(fp, "BUCKET_BYTES", bucket)
        rows = fp.with_next(odd_docs).collect()
        assert len(rows) == odd_docs.count()
        by = {r["doc_id"]: r for r in rows}
        nine, five = by[9], by[5]
        # the null id comes last and is followed by the largest id
        assert by[None]["next_text"] == nine["text"] and five["next_text"] == by[4]["text"]
        assert [r["text"] for r in rows if r["doc_id"] == 2] == [""]
    one = spark.createDataFrame([(7, "só um")], "doc_id long, text string")
    assert fp.with_next(one).first()["next_text"] == "só um"
    prints = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprint(odd_docs).collect()}
    assert prints[5] == prints[6] != "" and prints[2] == prints[3] == ""
    assert {r["near_edited"] for r in fp.compare_neighbours(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")).collect()} == {1.0}
