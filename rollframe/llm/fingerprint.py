"""Document fingerprints: improbable byte windows in chained Bloom filters."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _BYTE, CHUNK_BYTES, Powers, mix, text_bytes

WINDOW = 64
POPULAR = 16
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
TYPICAL = 4.0
BUCKET_BYTES = 32 << 20
BROADCAST_BUCKETS = 1_000_000
ROWS_AT_ONCE = 512
MARGIN = 0.1
PLACE_BITS = np.int64(21)
PLACE = (np.int64(1) << PLACE_BITS) - 1
# n * log2(n) in steps of 2^-20, so that sums along a text stay exact
_TERM = np.array([0] + [round(n * np.log2(n) * 2**20) for n in range(1, WINDOW + 1)], dtype=np.int64)
_GAIN = np.diff(_TERM)
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)


def window_terms(data: np.ndarray) -> np.ndarray:
    """Sum of n * log2(n) over the byte counts n of each window of 64 bytes, scaled: 64 * (6 - entropy).

    From one window to the next, the sum changes by what the byte that goes
    and the byte that comes have as company in the 63 bytes between; equal
    bytes at most 63 apart are counted over sorted positions.
    """
    n = len(data)
    order = np.argsort(data, kind="stable").astype(np.int32)
    at = order + data[order].astype(np.int32) * np.int32(n + WINDOW)
    later, earlier = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    for k in range(1, WINDOW):
        close = (at[k:] - at[:-k]) < WINDOW
        if not close.any():
            break
        later[:-k] += close
        earlier[k:] += close
    after, before = np.empty(n, dtype=np.uint8), np.empty(n, dtype=np.uint8)
    after[order], before[order] = later, earlier
    first = int(_TERM[np.bincount(data[:WINDOW], minlength=256)].sum())
    steps = _GAIN[before[WINDOW:]] - _GAIN[after[: n - WINDOW]]
    return first + np.r_[0, np.cumsum(steps)]


def rank(data: np.ndarray) -> np.ndarray:
    """A number per window, less for rarer ones, then for those further left; its low bits are the position."""
    rare = np.abs(window_terms(data) - round(WINDOW * (6 - TYPICAL) * 2**20))
    return (((np.int64(1) << 40) - rare) << PLACE_BITS) | np.arange(len(rare), dtype=np.int64)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours (a power of two)."""
    step = 1
    while step < width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return x


def features(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the selected features of several texts in a row, and the text each belongs to, in text order.

    A window is the rarer, the farther its entropy is from that of common text.
    Among each 64 neighbouring windows the rarest (leftmost) is marked; windows
    marked 16 times are features.  A text without any gives its rarest window,
    and a text shorter than a window is a feature as a whole.
    """
    sizes = np.diff(offsets)
    n = len(data)
    powers.reach(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers.up[:n], out=sums[1:])
    starts, owner = [], []
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    if n >= WINDOW:
        key = rank(data)
        long = np.flatnonzero(sizes >= 2 * WINDOW - 1 + POPULAR)
        if len(long):
            least = _sliding_least(key, WINDOW) & PLACE
            # neighbourhoods that lie in one text
            inside = np.zeros(n + 1, dtype=np.int64)
            np.add.at(inside, offsets[long], 1)
            np.add.at(inside, offsets[long + 1] - (2 * WINDOW - 2), -1)
            marks = np.bincount(least[np.cumsum(inside)[: len(least)] > 0], minlength=n)
            picked = np.flatnonzero(marks >= POPULAR)
            starts.append(picked)
            owner.append(np.searchsorted(offsets, picked, "right") - 1)
        none = np.ones(len(sizes), dtype=bool)
        none[np.concatenate(owner or [short])] = False
        for i in np.flatnonzero((sizes >= WINDOW) & none):
            own = key[offsets[i] : offsets[i + 1] - WINDOW + 1]
            starts.append(np.array([int(own.min() & PLACE)]))
            owner.append(np.array([i]))
    starts.append(offsets[short])
    owner.append(short)
    starts, owner = np.concatenate(starts), np.concatenate(owner)
    # empty texts share their offset with the next one: the owner is the text that has bytes there
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.minimum(starts + WINDOW, offsets[owner + 1])
    hashes = mix((sums[ends] - sums[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64))
    return hashes, owner


def fingerprints(texts: list[str], powers: Powers) -> list[bytes]:
    """One fingerprint per text: for each filter its number of features (one byte) and its 2048 bits."""
    out = [b""] * len(texts)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(raw):
        to, size = at, 0
        while to < len(raw) and (to == at or size + len(raw[to]) <= CHUNK_BYTES // 4):
            size += len(raw[to])
            to += 1
        if size < 1 << 20:
            offsets = np.r_[0, np.cumsum([len(r) for r in raw[at:to]])]
            hashes, owner = features(np.frombuffer(b"".join(raw[at:to]), dtype=np.uint8), offsets, powers)
        else:
            hashes, owner = _long_features(raw[at], powers)
        for i, print_ in _filters(hashes, owner).items():
            out[at + i] = print_
        at = to
    return out


def _long_features(raw: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Features of one long text, read in overlapping blocks; a block answers for the windows that start in it.

    Marks of a window come from neighbourhoods up to 64 windows around it, so
    blocks that overlap by that much on both sides select what the whole text
    would; where none selects any, the rarest window of all blocks is the feature.
    """
    block, margin, every, rarest = 1 << 19, 4 * WINDOW, [], []
    data = np.frombuffer(raw, dtype=np.uint8)
    for a in range(0, len(raw), block):
        low, high = max(0, a - margin), min(len(raw), a + block + margin)
        part = data[low:high]
        if len(part) < 2 * WINDOW - 1 + POPULAR and low > 0:
            low = max(0, high - 2 * margin)
            part = data[low:high]
        powers.reach(len(part) + 1)
        h, s, (rare, at, alone) = _with_starts(part, powers)
        own = (s + low >= a) & (s + low < a + block)
        every.append(h[own])
        rarest.append((rare, at + low, alone))
    hashes = np.concatenate(every)
    if not len(hashes):
        hashes = np.array([min(rarest)[2]], dtype=np.uint64)
    return hashes, np.zeros(len(hashes), dtype=np.int64)


def _with_starts(part: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int]]:
    """Hashes and starts of the marked windows, and the rarest one of all: rank, start, hash."""
    key = rank(part)
    marks = np.bincount(_sliding_least(key, WINDOW) & PLACE, minlength=len(part))
    starts, least = np.flatnonzero(marks >= POPULAR), int(key.argmin())
    sums = np.r_[np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[part] * powers.up[: len(part)])]
    at = np.r_[starts, least]
    hashes = mix((sums[at + WINDOW] - sums[at]) * powers.down[at] + np.uint64(WINDOW))
    return hashes[:-1], starts, (int(key[least] >> PLACE_BITS), least, int(hashes[-1]))


def _filters(hashes: np.ndarray, owner: np.ndarray) -> dict[int, bytes]:
    """Features, each once per text, into filters of 160 features, five bits each."""
    if not len(hashes):
        return {}
    order = np.lexsort((hashes, owner))
    new = np.ones(len(hashes), dtype=bool)
    new[order[1:]] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    hashes, owner = hashes[new], owner[new]
    first = np.r_[True, owner[1:] != owner[:-1]]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
    nth = np.arange(len(owner)) - begin
    slot = np.cumsum(first | (nth % FILTER_FEATURES == 0)) - 1
    bits = np.zeros((slot[-1] + 1, FILTER_BITS), dtype=bool)
    for j in range(HASHES):
        bits[slot, ((hashes >> np.uint64(11 * j)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed, counts = np.packbits(bits, axis=1), np.bincount(slot)
    owners = owner[np.r_[True, slot[1:] != slot[:-1]]]
    out: dict[int, list[bytes]] = {}
    for i, row, n in zip(owners.tolist(), packed, counts.tolist()):
        out.setdefault(i, []).append(bytes([n]) + row.tobytes())
    return {i: b"".join(parts) for i, parts in out.items()}


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: bits in common above chance, over the most there could be, for the best partner of each filter of the shorter chain.

    Equal fingerprints are 1; an empty one is like nothing else.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    rows = 1 + FILTER_BITS // 8
    x, y = (np.frombuffer(v, dtype=np.uint8).reshape(-1, rows) for v in sorted((a, b), key=lambda v: (len(v), v)))
    bits_x, bits_y = _ONES[x[:, 1:]].sum(1), _ONES[y[:, 1:]].sum(1)
    n_x, n_y = x[:, 0].astype(float), y[:, 0].astype(float)
    stay = 1 - 1 / FILTER_BITS
    best = []
    for i in range(len(x)):
        both = _ONES[x[i, 1:] & y[:, 1:]].sum(1)
        chance = FILTER_BITS * (1 - stay ** (HASHES * n_x[i]) - stay ** (HASHES * n_y) + stay ** (HASHES * (n_x[i] + n_y)))
        most = np.minimum(bits_x[i], bits_y)
        floor = chance + MARGIN * np.maximum(0, most - chance)
        best.append(float(np.clip((both - floor) / np.maximum(most - floor, 1e-9), 0, 1).max()))
    return sum(best) / len(best)


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``next_text``: the text of the next row by falling doc_id, the first after the last.

    Rows are cut into ranges of doc_id of about ``BUCKET_BYTES``; the first row
    of each range is also sent to the range before it, so one shuffle by range
    brings each row next to its follower.  The list of first rows, one id and
    hash per range, is broadcast up to ``BROADCAST_BUCKETS`` ranges.  Null ids come last; rows with one id
    are ordered by a hash of their text.  Null texts count as empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = max(1, -(-text_bytes(rows) // BUCKET_BYTES))
    bounds = []
    if count > 1:
        cuts = [i / count for i in range(1, count)]
        bounds = rows.agg(F.percentile_approx("doc_id", cuts, 100 * count)).first()[0] or []
    edges = np.unique(np.array(bounds, dtype=np.int64))

    @F.pandas_udf("long")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(len(edges) - np.searchsorted(edges, ids.to_numpy(), "left"))

    last = F.lit(len(edges)).cast("long")
    place = F.when(F.col("doc_id").isNull(), last).otherwise(bucket(F.coalesce("doc_id", F.lit(0).cast("long"))))
    rows = rows.withColumn("_tie", F.xxhash64("text")).withColumn("_bucket", place if len(edges) else last)
    heads = rows.groupBy("_bucket").agg(F.max(F.struct("doc_id", "_tie")).alias("h"))
    along = W.orderBy("_bucket")
    to = F.coalesce(F.lag("_bucket").over(along), F.max("_bucket").over(W.partitionBy()))
    heads = heads.select(to.alias("_to"), F.col("h.doc_id").alias("_id"), F.col("h._tie").alias("_h"))
    if count <= BROADCAST_BUCKETS:
        heads = F.broadcast(heads)
    guests = rows.join(heads, rows["doc_id"].eqNullSafe(heads["_id"]) & (rows["_tie"] == heads["_h"]))
    guests = guests.select("doc_id", "text", "_tie", F.col("_to").alias("_bucket"), F.lit(1).alias("_guest"))
    every = rows.withColumn("_guest", F.lit(0)).unionByName(guests)
    order = W.partitionBy("_bucket").orderBy("_guest", F.desc_nulls_last("doc_id"), F.desc("_tie"))
    every = every.withColumn("next_text", F.lead("text").over(order))
    return every.where("_guest = 0").select("doc_id", "text", "next_text")


def edit(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as many characters of ``following``, or all it has."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _compare(batches):
    powers = Powers()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            texts, following = part.column("text").to_pylist(), part.column("next_text").to_pylist()
            edited = [edit(t, f) for t, f in zip(texts, following)]
            distinct = list(dict.fromkeys([*texts, *following, *edited]))
            known = dict(zip(distinct, fingerprints(distinct, powers)))
            columns = [
                part.column("doc_id"),
                pa.array([len(t) for t in texts], type=pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited]),
                pa.array([known[t].hex() for t in texts]),
                pa.array([known[e].hex() for e in edited]),
                pa.array([likeness(known[t], known[e]) for t, e in zip(texts, edited)], type=pa.float64()),
                pa.array([likeness(known[t], known[f]) for t, f in zip(texts, following)], type=pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text), of its edited text (see ``edit``), and their likeness.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint and
    edited_fingerprint (hex), near_edited, near_next.  A null or empty text has
    an empty fingerprint; two of those are alike (1.0).  The only row of a
    table is its own neighbour; an empty table gives no rows.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(_compare, schema)


def _fingerprint(batches):
    powers = Powers()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            prints = fingerprints([t or "" for t in part.column("text").to_pylist()], powers)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([p.hex() for p in prints])], names=["doc_id", "fingerprint"])


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex; empty for null and empty texts) of each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint, "doc_id long, fingerprint string")
