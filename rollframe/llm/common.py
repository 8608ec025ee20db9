"""Words, hashes and packed rows shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import pickle
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

CHUNK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as far as a text is long."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))


class Words:
    """The words of a run of documents: 64-bit hashes, byte ranges, and each document's range of words."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, powers: Powers, fold_case: bool) -> None:
        self.first, self.data, self.offsets = first, data, offsets
        if fold_case:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        n = len(data)
        solid = ~_SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        before[:1], before[1:] = False, solid[:-1]
        after = np.empty(n, dtype=bool)
        after[-1:], after[:-1] = False, solid[1:]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        powers.reach(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * powers.up[:n], out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * powers.down[self.starts]
        self.hashes = mix(raw + (self.ends - self.starts).astype(np.uint64) * _ODD)
        self.bounds = np.searchsorted(self.starts, offsets)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash of the ``k`` words from each word on, and whether they lie in one document."""
        n = len(self.hashes)
        out = np.zeros(n, dtype=np.uint64)
        if n >= k:
            for j in range(k):
                out[: n - k + 1] = out[: n - k + 1] * _ODD + self.hashes[j : n - k + 1 + j]
        whole = np.arange(n) + k <= np.repeat(self.bounds[1:], np.diff(self.bounds))
        return mix(out + np.uint64(k)), whole

    def __len__(self) -> int:
        return len(self.offsets) - 1


def read_words(column: pa.Array, powers: Powers, fold_case: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a text column (null: none), about ``limit`` bytes at a time; a longer text comes alone."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    _, raw, data = texts.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        own = offsets[at : to + 1]
        yield Words(at, everything[own[0] : own[-1]], own - own[0], powers, fold_case)
        at = to


def shard_count(docs: DataFrame, shard_bytes: int) -> int:
    """Shards of about ``shard_bytes`` of text, and at least one per shuffle partition."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, -(-text_bytes(docs) // shard_bytes))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*cols: str | Column, seed: int | str = 0) -> Column:
    """A reproducible uniform number in (0, 1) with 52 random bits."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in cols]
    digits = F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def row_key(*cols: str | Column) -> Column:
    """A 64-bit key that tells rows with one id but different texts apart."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.xxhash64(*[F.coalesce(p, F.lit("\x00null")) for p in parts])


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: sizes shards, never a result."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


def send(spark: SparkSession, value):
    """Broadcast a model with its class, so that executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent):
    return pickle.loads(sent.value)


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and the C heap else hold it as long as the process lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` over a task's batches; its Python worker, which lives on for other tasks, then gives back what it freed."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def kept_in_worker(key, make):
    """The value made for ``key`` by an earlier task of this Python worker, or a new one."""
    kept = sys.modules.setdefault("rollframe_worker", types.ModuleType("rollframe_worker"))
    name = repr(key)
    if name not in vars(kept):
        setattr(kept, name, make())
    return getattr(kept, name)
