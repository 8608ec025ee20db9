"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, received, send

BITS = 16
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 1000
CHUNK_CHARS = 1 << 18
SLICES = 16


def _features(texts: list[str], bits: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts in a row, and where each text's begin (one more entry at the end).

    Texts are lower-cased and stand between spaces; a gram of order n ends at
    each character and never reaches back into another text.
    """
    padded = [f" {t} ".lower() for t in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum([len(p) for p in padded])
    place = np.arange(len(code)) - np.repeat(np.r_[0, ends[:-1]], np.diff(np.r_[0, ends]))
    grams, keep = [], []
    state = np.zeros(len(code), dtype=np.uint64)
    for n in range(1, max(orders) + 1):
        shifted = np.zeros_like(code)
        shifted[n - 1 :] = code[: len(code) - n + 1]
        state = state * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(1)
        if n in orders:
            grams.append((mix(state + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64))
            keep.append(place >= n - 1)
    # grams of one character lie together, so each text's are one range
    every, good = np.stack(grams, 1).ravel(), np.stack(keep, 1).ravel()
    before = np.r_[0, np.cumsum(good)]
    return every[good], before[np.r_[0, ends] * len(grams)]


def _chunks(texts: list[str | None]):
    """Ranges of texts of bounded length together; a longer text comes alone."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= CHUNK_CHARS):
            size += len(texts[to] or "")
            to += 1
        yield at, to
        at = to


def _count(bits: int, orders: tuple[int, ...]):
    def run(batches):
        totals: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in dict.fromkeys(langs):
                own = [t or "" for t, x in zip(texts, langs) if x == lang]
                count = totals.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                seen[lang] = seen.get(lang, 0) + len(own)
                for a, b in _chunks(own):
                    count += np.bincount(_features(own[a:b], bits, orders)[0], minlength=1 << bits)
        width = (1 << bits) // SLICES
        for lang, count in totals.items():
            parts = [count[i * width : (i + 1) * width].tobytes() for i in range(SLICES)]
            docs = [seen[lang]] + [0] * (SLICES - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * SLICES), pa.array(range(SLICES), type=pa.int32()), pa.array(docs, type=pa.int64()), pa.array(parts, type=pa.binary())],
                names=["lang", "slice", "docs", "counts"],
            )

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, dtype=np.int64) for b in table.column("counts").to_pylist())
    docs = sum(table.column("docs").to_pylist())
    return pa.table({
        "lang": table.column("lang").slice(0, 1), "slice": table.column("slice").slice(0, 1),
        "docs": pa.array([docs], type=pa.int64()), "counts": pa.array([total.tobytes()], type=pa.binary()),
    })


class LanguageModel:
    """Log-probabilities of hashed n-grams per language: at most ``MAX_LANGUAGES`` x 2^bits doubles."""

    def __init__(self, langs: list[str], priors: np.ndarray, matrix: np.ndarray, bits: int, orders: tuple[int, ...]) -> None:
        self.langs, self.priors, self.matrix, self.bits, self.orders = langs, priors, matrix, bits, orders


def train(labelled: DataFrame, bits: int = BITS, orders: tuple[int, ...] = ORDERS, smoothing: float = 0.5) -> LanguageModel:
    """Count the n-grams of every row of ``labelled`` (text, lang) by language.

    Tasks add up their own rows, so what is shuffled and collected is one
    vector per language whatever the number of rows.  Rows without a language
    are left out; more than ``MAX_LANGUAGES`` languages are an error.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    partial = rows.where("lang IS NOT NULL").mapInArrow(_count(bits, orders), "lang string, slice int, docs long, counts binary")
    sums = partial.groupBy("lang", "slice").applyInArrow(_add, partial.schema)
    found: dict[str, tuple[int, dict[int, np.ndarray]]] = {}
    for r in sums.toLocalIterator():
        docs, parts = found.get(r["lang"], (0, {}))
        parts[r["slice"]] = np.frombuffer(bytes(r["counts"]), dtype=np.int64)
        found[r["lang"]] = (docs + r["docs"], parts)
        if len(found) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(found)
    counts = np.array([np.concatenate([found[x][1][i] for i in range(SLICES)]) for x in langs], dtype=float)
    counts = counts.reshape(len(langs), 1 << bits) + smoothing
    docs = np.array([found[x][0] for x in langs], dtype=float)
    return LanguageModel(langs, np.log(docs / docs.sum()), np.log(counts / counts.sum(1, keepdims=True)), bits, orders)


def _score(model, evidence: float):
    def run(batches):
        m: LanguageModel = received(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            best, score = ["und"] * len(texts), np.zeros(len(texts))
            real = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if m.langs else []
            own = [texts[i] for i in real]
            for a, b in _chunks(own):
                grams, bounds = _features(own[a:b], m.bits, m.orders)
                sums = np.stack([np.add.reduceat(row[grams], bounds[:-1]) for row in m.matrix], 1)
                whole = sums + m.priors
                top = whole.argmax(1)
                # for the score, a long text is no more evidence than ``evidence`` grams of it, so it stays graded
                n = np.diff(bounds)[:, None]
                share = np.exp((whole - whole.max(1, keepdims=True)) * np.minimum(1.0, evidence / n))
                share /= share.sum(1, keepdims=True)
                for j, i in enumerate(real[a:b]):
                    best[i], score[i] = m.langs[top[j]], share[j, top[j]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(best), pa.array(score)], names=["doc_id", "lang_pred", "score"]
            )

    return run


def identify(docs: DataFrame, model: LanguageModel, evidence: float = 60.0) -> DataFrame:
    """Language of each row of ``docs`` (doc_id, text): doc_id, lang_pred, score (tempered posterior of that language).

    The language is that of the highest posterior over the whole text.  For the
    score, log-likelihoods and priors of a text of more than ``evidence`` grams
    are scaled down to so many.
    Null texts and texts without a letter are ``und`` with score 0, and so is
    everything if no language was learned.  Ties go to the first language by
    code point.  One row per input row, repeated rows and null ids included.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = send(docs.sparkSession, model)
    return rows.mapInArrow(_score(sent, evidence), "doc_id long, lang_pred string, score double")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % folds
