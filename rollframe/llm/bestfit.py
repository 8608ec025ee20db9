"""Best-fit packing by bin completion: undominated fillings around the largest piece, branch and bound on the waste."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _ODD, Powers, kept_in_worker, mix

CAPACITY = 2048
GROUP_PIECES = 4096
BLOCK_BYTES = 1 << 20
SEGMENTS_KEPT = 1 << 21
#: Steps back of the search: bins whose fillings have all been tried.
RETRIES = 100
#: Fillings of one waste that are tried for a bin.
WIDTH = 8

_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[[ord(c) for c in ".,;:!?"]] = True


# ---------------------------------------------------------------- packing
def best_fit_decreasing(sizes: Counter, capacity: int) -> list[list[int]]:
    """Bins of sizes: each, from the largest on, into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    for size in sorted(sizes, reverse=True):
        for _ in range(sizes[size]):
            enough = rooms >> size
            if enough:
                room = size + (enough & -enough).bit_length() - 1
                at = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, at = capacity, len(bins)
                bins.append([])
            bins[at].append(size)
            by_room.setdefault(room - size, []).append(at)
            rooms |= 1 << (room - size)
    return bins


def least_bins(sizes: Counter, capacity: int) -> int:
    """No packing has fewer bins: for every k, pieces over capacity - k stand alone and those under k are left out."""
    n = np.zeros(capacity + 2, dtype=np.int64)
    for size, count in sizes.items():
        n[size] = count
    upto, mass = np.cumsum(n), np.cumsum(n * np.arange(capacity + 2))
    k = np.arange(0, capacity // 2 + 1)
    alone = upto[-1] - upto[capacity - k]
    large = upto[capacity - k] - upto[capacity // 2]
    room = large * capacity - (mass[capacity - k] - mass[capacity // 2])
    small = mass[capacity // 2] - np.where(k > 0, mass[np.maximum(k - 1, 0)], 0)
    return int((alone + large + np.maximum(0, -(-(small - room) // capacity))).max())


class Pool:
    """The sizes that are still to be packed, as counts and as bits from both ends."""

    def __init__(self, sizes: Counter, capacity: int) -> None:
        self.capacity, self.count = capacity, Counter(sizes)
        self.bits = sum(1 << s for s in sizes)
        self.back = sum(1 << (capacity - s) for s in sizes)

    def largest(self, most: int) -> int:
        """The largest size up to ``most``; 0 if there is none."""
        return max(0, (self.bits & ((2 << most) - 1)).bit_length() - 1) if most > 0 else 0

    def take(self, sizes) -> None:
        for s in sizes:
            self.count[s] -= 1
            if not self.count[s]:
                self.bits &= ~(1 << s)
                self.back &= ~(1 << (self.capacity - s))

    def put(self, sizes) -> None:
        for s in sizes:
            self.count[s] += 1
            self.bits |= 1 << s
            self.back |= 1 << (self.capacity - s)

    def has(self, sizes: tuple[int, ...]) -> bool:
        return all(self.count[s] >= sizes.count(s) for s in sizes)

    def pairs(self, total: int, most: int) -> Iterator[tuple[int, int]]:
        """Two sizes, neither over ``most``, that make ``total``; the most unequal first."""
        if total < 2:
            return
        # bit a: both a and total - a are there
        both = self.bits & (self.back >> (self.capacity - total))
        both &= (2 << min(most, total - 1)) - 1
        both = both >> (-(-total // 2)) << (-(-total // 2))
        while both:
            a = both.bit_length() - 1
            both &= ~(1 << a)
            yield a, total - a

    def one_or_two(self, total: int) -> Iterator[tuple[int, ...]]:
        """A size or two that make ``total``, large ones first."""
        if total <= self.capacity and self.bits >> total & 1:
            yield (total,)
        yield from (p for p in self.pairs(total, total) if self.has(p))

    def three(self, total: int) -> Iterator[tuple[int, ...]]:
        a = self.largest(total - 2)
        while a and 3 * a >= total:
            yield from ((a, *p) for p in self.pairs(total - a, a) if self.has((a, *p)))
            a = self.largest(a - 1)

    def totals(self, room: int) -> int:
        """Bits of the sums of up to three sizes, within a room; a size may have been used more often than it is there."""
        inside, ones = (2 << room) - 1, self.bits & ((2 << room) - 1)
        twos = threes = 0
        sizes = [i for i, b in enumerate(reversed(bin(ones)[2:])) if b == "1"]
        for s in sizes:
            twos |= ones << s
        twos &= inside
        for s in sizes:
            threes |= twos << s
        return 1 | ones | twos | threes & inside

    def dominated(self, filling: tuple[int, ...], waste: int) -> bool:
        """Whether one unused size could stand in for some of the filling and use as much room or more."""
        sums = {0}
        for s in filling:
            sums |= {x + s for x in sums}
        for y in sums:
            single = y == 0 or y in filling
            first = y + 1 if single else y
            if (self.bits >> first) & ((1 << (y + waste - first + 1)) - 1):
                return True
        return False

    def fillings(self, room: int, allowed: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Undominated fillings of a room as (sizes, waste), the least waste first, up to ``allowed``.

        Rooms of more than three of the largest size take that size first.
        Of the fillings of one waste, ``WIDTH`` are given, out of four times as
        many: more would differ in sizes, not in the room that they use.  Between two fillings the pool is
        as the caller left it.
        """
        held: tuple[int, ...] = ()
        most = self.largest(room)
        while most and 3 * most < room:
            held, room = (*held, most), room - most
            self.take((most,))
            most = self.largest(room)

        def candidates() -> Iterator[tuple[int, Iterator]]:
            yield room, self.one_or_two(room)
            totals = self.totals(room)
            if totals >> room & 1:
                yield room, self.three(room)
            totals &= (1 << room) - 1
            while totals and room - (total := totals.bit_length() - 1) <= allowed:
                totals &= ~(1 << total)
                yield total, chain(self.one_or_two(total), self.three(total))

        for total, some in candidates() if room else [(0, iter([()]))]:
            waste, given = room - total, 0
            for filling in islice(some, 4 * WIDTH) if total else [()]:
                self.take(filling)
                good = not self.dominated(filling, waste)
                self.put(filling)
                if good:
                    self.put(held)
                    yield held + filling, waste
                    self.take(held)
                given += good
                if given == WIDTH:
                    break
        self.put(held)


def bin_completion(sizes: Counter, capacity: int = CAPACITY, retries: int = RETRIES) -> list[list[int]]:
    """Bins of sizes between 1 and ``capacity``, as few as the search finds.

    The incumbent is the best-fit packing.  If it has more bins than the lower
    bound, bins are completed one by one: the largest size left, with every
    undominated filling of its room, the least waste first.  A branch whose
    waste exceeds what a packing with fewer bins than the incumbent can have is
    cut off.  A better packing becomes the incumbent; the search ends at the
    lower bound, with all branches tried, or after ``retries`` steps back.
    """
    best = best_fit_decreasing(sizes, capacity)
    bound, mass = least_bins(sizes, capacity), sum(s * n for s, n in sizes.items())
    pool = Pool(sizes, capacity)
    frames: list[list] = []  # of each open bin: its largest size, the fillings left to try, the one in use, the waste before it
    waste, forward = 0, True
    while len(best) > bound:
        limit = (len(best) - 1) * capacity - mass
        first = pool.largest(capacity)
        if forward and not first:  # all is packed, in fewer bins than before: the waste allows no others
            best = [[f[0], *f[2]] for f in frames]
            forward = False
            pool.put(frames[-1][2])
            continue
        if forward:
            pool.take((first,))
            frames.append([first, pool.fillings(capacity - first, limit - waste), (), waste])
        frame = frames[-1]
        filling, more = next(frame[1], ((), limit + 1))
        if frame[3] + more <= limit:
            pool.take(filling)
            frame[2], waste, forward = filling, frame[3] + more, True
            continue
        pool.put((frames.pop()[0],))
        retries -= 1
        if not frames or retries < 0:
            break
        pool.put(frames[-1][2])
        forward = False
    return best


# ---------------------------------------------------------------- tokens
def segment_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where texts, which begin at ``texts``, can be cut so that the tokens of the parts are those of the whole.

    The byte-level tokenizer joins a space to what follows it, never to what
    stands before it, unless both neighbours are white space: a space beside a
    visible ASCII character on either side is a start.  Nor does it join a
    letter to a mark after it, but for an apostrophe.
    """
    seen = (data > 0x20) & (data < 0x7F)
    beside = np.zeros(len(data), dtype=bool)
    beside[1:] |= seen[:-1]
    beside[:-1] |= seen[1:]
    starts = (data == 0x20) & beside
    starts[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    starts[texts] = True
    return np.flatnonzero(starts)


class SegmentIds:
    """Token ids by segment hash: sorted hashes, and each segment's range in one flat array of ids.

    A segment is encoded once and looked up after that, by all tasks of one
    Python worker.  When more than ``keep`` segments (about 40 bytes each) are
    known, all are forgotten.
    """

    def __init__(self, vocabulary: str, keep: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(vocabulary), keep
        tokens = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(tokens.values()) + 1, dtype=bool)
        self.opens[[i for t, i in tokens.items() if t.startswith("\u0120")]] = True
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.starts, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def encode(self, segments: list[str]) -> list[list[int]]:
        """Ids of each; segments that are a space and letters go many at a time, as the space opens a token."""
        out: list[list[int]] = [[]] * len(segments)
        plain = [i for i, s in enumerate(segments) if s[0] == " " and s[1:].isalpha()]
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            ids = np.array(self.tokenizer.encode("".join([segments[i] for i in some]), add_special_tokens=False).ids)
            ends = [*np.flatnonzero(self.opens[ids])[1:].tolist(), len(ids)]
            if len(ends) == len(some):
                ids = ids.tolist()
                for i, a, b in zip(some, [0, *ends], ends):
                    out[i] = ids[a:b]
        rest = [i for i, ids in enumerate(out) if not ids]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([segments[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def read(self, data: np.ndarray, starts: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments that begin at ``starts`` (the last ends with the data), and how many each has."""
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        ends = np.r_[starts[1:], len(data)]
        powers.reach(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * powers.up[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64) * _ODD)
        order = np.argsort(hashes)
        opens = np.r_[True, np.diff(hashes[order]) != 0]
        first = order[opens]
        unique, back = hashes[first], np.empty(len(hashes), dtype=np.int64)
        back[order] = np.cumsum(opens) - 1
        at = np.searchsorted(self.hashes, unique)
        new = np.ones(len(unique), dtype=bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != unique[inside]
        if new.any():
            if len(self.hashes) + new.sum() > self.keep:
                self.forget()
                new[:] = True
            raw = data.tobytes()
            got = self.encode([raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            sizes = np.array([len(x) for x in got], dtype=np.int64)
            at = np.searchsorted(self.hashes, unique[new])
            self.hashes = np.insert(self.hashes, at, unique[new])
            self.starts = np.insert(self.starts, at, len(self.flat) + np.cumsum(sizes) - sizes)
            self.sizes = np.insert(self.sizes, at, sizes)
            self.flat = np.r_[self.flat, np.array([i for x in got for i in x], dtype=np.uint32)]
        known = np.searchsorted(self.hashes, unique)
        sizes = self.sizes[known][back]
        upto = np.cumsum(sizes)
        place = np.arange(upto[-1]) + np.repeat(self.starts[known][back] - (upto - sizes), sizes)
        return self.flat[place], sizes


def token_runs(texts: pa.Array, lookup: SegmentIds, powers: Powers, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its ids) of a text column, read about ``limit`` bytes at a time; a longer text is read in parts."""
    texts = texts.cast(pa.large_string())
    _, raw, buffer = texts.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    everything = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        data = everything[offsets[row] : offsets[to]]
        if len(data) <= limit:
            bounds = offsets[row : to + 1] - offsets[row]
            starts = segment_starts(data, bounds[:-1][np.diff(bounds) > 0])
            ids, sizes = lookup.read(data, starts, powers)
            edges = np.r_[0, np.cumsum(sizes)][np.searchsorted(starts, bounds)]
            for i in range(to - row):
                yield row + i, ids[edges[i] : edges[i + 1]]
        else:
            starts, parts, at = segment_starts(data, np.zeros(1, dtype=np.int64)), [], 0
            while at < len(starts):
                end = max(at + 1, int(np.searchsorted(starts, starts[at] + limit, "right")))
                stop = int(starts[end]) if end < len(starts) else len(data)
                begin = int(starts[at])
                parts.append(lookup.read(data[begin:stop], starts[at:end] - begin, powers)[0])
                at = end
            yield row, np.concatenate(parts)
        row = to


def pieces(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole sequences, the shorter piece in front."""
    first = (tokens - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, tokens, capacity))]


def _cut(vocabulary: str, end_id: int, capacity: int, groups: int, keep: int, limit: int):
    """Texts to their pieces, each with the group in which it is packed.

    Groups follow from a hash of document, text and piece, and for equal rows
    from how many of them the task has seen, so that equal rows spread too and
    the same rows always make the same pieces.
    """

    def run(batches):
        lookup, powers = kept_in_worker((vocabulary, keep, "segments"), lambda: SegmentIds(vocabulary, keep)), Powers()
        copies: dict[int, int] = {}
        for batch in batches:
            docs, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            rows: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids", "seed")}
            held = 0

            def ready():
                seeds = mix(np.array(rows.pop("seed"), dtype=np.uint64))
                spread = mix(seeds + np.array(rows["piece"], dtype=np.uint64) * _ODD)
                arrays = [pa.array(v, type=pa.binary() if n == "ids" else pa.int64()) for n, v in rows.items()]
                return pa.RecordBatch.from_arrays([*arrays, pa.array((spread % np.uint64(groups)).astype(np.int64))], names=[*rows, "group"])  # noqa: B023

            for row, ids in token_runs(batch.column("text"), lookup, powers, limit):
                ids = np.r_[ids, np.uint32(end_id)].astype("<u4")
                seen = copies[keys[row]] = copies.get(keys[row], -1) + 1
                for number, (start, length) in enumerate(pieces(len(ids), capacity)):
                    seed = (keys[row] + seen * 0x9E3779B97F4A7C15) % (1 << 64)
                    for name, value in zip(rows, (docs[row], number, start, length, ids[start : start + length].tobytes(), seed)):
                        rows[name].append(value)
                held += len(ids)
                if held > 1 << 20:
                    yield ready()
                    rows, held = {n: [] for n in ("doc_id", "piece", "start", "length", "ids", "seed")}, 0
            if rows["piece"]:
                yield ready()

    return run


def _pack(capacity: int, retries: int):
    def run(table: pa.Table) -> pa.Table:
        # a fixed order, whatever order the shuffle delivered
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids", "ascending")])
        lengths = table.column("length").to_numpy()
        first = {int(s): int(np.searchsorted(-lengths, -s)) for s in np.unique(lengths)}
        sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        for number, sizes in enumerate(bin_completion(Counter(lengths.tolist()), capacity, retries)):
            at = 0
            for size in sizes:  # equal sizes are dealt in their order
                sequence[first[size]], offset[first[size]] = number, at
                first[size] += 1
                at += size
        base = table.column("group")[0].as_py() << 32 if len(lengths) else 0
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(base + sequence)).append_column("offset", pa.array(offset))

    return run


def pack_best_fit(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, group_pieces: int = GROUP_PIECES, retries: int = RETRIES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The tokens of ``docs`` (doc_id, text) in as few sequences of at most ``capacity`` tokens as the search finds.

    A document is the ids of its text and then ``end_id``.  Only one of more
    than ``capacity`` ids is cut: into pieces of that length, after a first one
    that holds the rest.  Pieces are dealt by hash to groups of about
    ``group_pieces`` (estimated from bytes, so a group of long pieces is no
    larger), each of which is packed in a task by bin completion: best-fit
    decreasing, then branch and bound over undominated fillings around the
    largest piece.  A group ends up at most a few sequences above the least
    possible; between groups nothing is shared.

    Columns: doc_id, piece (from 0), start, length, ids (unsigned 32-bit
    little-endian), sequence_id, offset.  Texts of any length are read in
    parts.  A null or empty text is its end id alone; a null doc_id stays null;
    repeated rows are packed as often as they occur; pieces of equal length
    keep the order of doc_id; an empty table gives no rows.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = picked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-(size["n"] + size["bytes"] // (4 * capacity)) // group_pieces))
    keyed = picked.withColumn("key", F.xxhash64("doc_id", F.xxhash64("text")))
    schema = "doc_id long, piece long, start long, length long, ids binary"
    cut = keyed.mapInArrow(_cut(vocabulary, end_id, capacity, groups, SEGMENTS_KEPT, block_bytes), f"{schema}, group long")
    return cut.groupBy("group").applyInArrow(_pack(capacity, retries), f"{schema}, sequence_id long, offset long")
