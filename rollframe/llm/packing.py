"""Packing of token sequences: first-fit decreasing with a tournament tree, in random groups of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, Words, kept_in_worker, mix, read_words, tidy

GROUP_DOCS = 4096
GROUP_BYTES = 64 << 20
CAPACITY = 2048
WORDS_KEPT = 1 << 20
ROWS_AT_ONCE = 1024


class Tournament:
    """Free room of bins under a tree of maxima; the leftmost bin with enough room is found by descent."""

    def __init__(self, bins: int, room: int) -> None:
        self.width = 1
        while self.width < max(1, bins):
            self.width *= 2
        self.best = [room] * (2 * self.width)

    def place(self, size: int) -> int:
        """The leftmost bin with room for ``size``, which it takes up."""
        at = 1
        while at < self.width:
            at *= 2
            if self.best[at] < size:
                at += 1
        self.best[at] -= size
        found = at - self.width
        at //= 2
        while at:
            self.best[at] = max(self.best[2 * at], self.best[2 * at + 1])
            at //= 2
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; every size is between 1 and ``capacity``."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    tree = Tournament(len(sizes), capacity)
    bins: list[list[int]] = []
    for i in order:
        b = tree.place(sizes[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def powers_of_two(n: int) -> list[int]:
    """``n`` as a falling sum of powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_group(lengths: list[int], capacity: int = CAPACITY, least_gap: int = 16) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token once.

    Documents are cut at multiples of the capacity and their rests packed.
    The emptiest sequences are then cut up to fill the gaps of the others; one
    is left over at most, and it is cut at powers of two, which need no padding.
    """
    full = [[(d, s, capacity)] for d, n in enumerate(lengths) for s in range(0, n - n % capacity, capacity)]
    rest = [(d, n - n % capacity, n % capacity) for d, n in enumerate(lengths) if n % capacity]
    packed = [[rest[i] for i in b] for b in first_fit_decreasing([r[2] for r in rest], capacity)]
    packed.sort(key=lambda b: -sum(p[2] for p in b))
    filled, low, high = [], len(packed) - 1, 0
    while high < low:
        taker = packed[high]
        gap = capacity - sum(p[2] for p in taker)
        while gap >= least_gap and high < low:
            d, s, n = packed[low].pop()
            take = min(n, gap)
            taker.append((d, s, take))
            gap -= take
            if take < n:
                packed[low].append((d, s + take, n - take))
            elif not packed[low]:
                low -= 1
        if gap >= least_gap:
            break  # no donor is left
        filled.append(taker)
        high += 1
    for left in packed[high : low + 1]:
        if sum(p[2] for p in left) + least_gap > capacity:
            filled.append(left)
            continue
        pieces = list(left)
        for size in powers_of_two(sum(p[2] for p in left)):
            part = []
            while size:
                d, s, n = pieces.pop()
                take = min(n, size)
                part.append((d, s, take))
                size -= take
                if take < n:
                    pieces.append((d, s + take, n - take))
            filled.append(part)
    return full + filled


class WordIds:
    """Token ids by word hash: sorted hashes, and each word's range in one flat array of ids.

    The tokenizer never joins anything across white space, so a word is encoded
    once and looked up after that, by all tasks of one Python worker.  When
    more than ``keep`` words (about 40 bytes each) are known, all are forgotten.
    """

    def __init__(self, vocabulary: str, keep: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(vocabulary), keep
        tokens = self.tokenizer.get_vocab()
        self.last = np.zeros(max(tokens.values()) + 1, dtype=bool)
        self.last[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self.marks = {m: self.encode([m])[0] for m in ".,"}
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.starts, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode_letters(self, words: list[str]) -> list[list[int]]:
        """Words of letters only, many in one go: each ends with the first id that can end a word."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype=np.int64)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            return self.encode(words)
        ids, ends = ids.tolist(), ends.tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.hashes) + len(words) > self.keep:
            self.forget()
        stems, tails, letters, others = [""] * len(words), [""] * len(words), [], []
        for i, word in enumerate(words):
            # a mark after a letter is a token of its own
            stem, tail = (word[:-1], word[-1]) if word[-1] in self.marks else (word, "")
            if stem.isalpha():
                stems[i], tails[i] = stem.lower() if stem.isascii() else stem, tail
                letters.append(i)
            else:
                stems[i] = word
                others.append(i)
        got: dict[str, list[int]] = {}
        plain = list(dict.fromkeys(stems[i] for i in letters))
        for a in range(0, len(plain), 2000):
            got.update(zip(plain[a : a + 2000], self.encode_letters(plain[a : a + 2000])))
        got.update(zip([stems[i] for i in others], self.encode([stems[i] for i in others])))
        new = [got[s] + self.marks[t] if t else got[s] for s, t in zip(stems, tails)]
        sizes = np.array([len(x) for x in new], dtype=np.int64)
        starts = len(self.flat) + np.r_[0, np.cumsum(sizes)[:-1]]
        self.flat = np.r_[self.flat, np.array([i for x in new for i in x], dtype=np.uint32)]
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts, self.sizes = np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), dtype=bool)

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        if not len(words.hashes):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        unique, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        new = ~self.known(unique)
        if new.any():
            if len(self.hashes) + new.sum() > self.keep:
                new[:] = True  # learn() starts afresh
            at = first[new]
            self.learn(unique[new], [words.data[s:e].tobytes().decode() for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist())])
        known = np.searchsorted(self.hashes, unique)
        sizes = self.sizes[known][back]
        upto = np.cumsum(sizes)
        place = np.arange(upto[-1]) + np.repeat(self.starts[known][back] - (upto - sizes), sizes)
        return self.flat[place], sizes


def _tokenize(vocabulary: str, end_id: int, groups: int, keep: int = WORDS_KEPT):
    """Arrow batches with ``text`` to the same with ``ids``: unsigned 32-bit little-endian.

    The group follows from the row's key and, for equal rows, from how many of
    them the task has seen, so that equal rows spread too.
    """

    def run(batches):
        lookup, powers = kept_in_worker((vocabulary, keep), lambda: WordIds(vocabulary, keep)), Powers()
        end = np.array([end_id], dtype="<u4").tobytes()
        copies: dict[int, int] = {}
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            keys = batch.column("_key").to_pylist()
            for i, key in enumerate(keys):
                seen = copies[key] = copies.get(key, -1) + 1
                keys[i] = (key + seen * 0x9E3779B97F4A7C15) % (1 << 64)
            group = mix(np.array(keys, dtype=np.uint64)) % np.uint64(groups)
            out = []
            for words in read_words(batch.column("text"), powers):
                ids, sizes = lookup.read(words)
                bounds = np.r_[0, np.cumsum(sizes)][words.bounds].tolist()
                raw = ids.astype("<u4").tobytes()
                out += [raw[4 * a : 4 * b] + end for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(group.astype(np.int64)), pa.array(out, type=pa.binary())],
                names=["doc_id", "_group", "ids"],
            )

    return tidy(run)


def _pack(capacity: int, least_gap: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, docs = table.column("ids").to_pylist(), table.column("doc_id").to_pylist()
        # a fixed order, whatever order the shuffle delivered
        order = sorted(range(len(ids)), key=lambda i: (docs[i] is None, docs[i] or 0, ids[i]))
        ids, docs = [ids[i] for i in order], [docs[i] for i in order]
        base = (table.column("_group")[0].as_py() << 32) if len(ids) else 0
        rows = {n: [] for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
        for number, sequence in enumerate(pack_group([len(x) // 4 for x in ids], capacity, least_gap)):
            at = 0
            for d, start, length in sequence:
                piece = ids[d][4 * start : 4 * (start + length)]
                for name, value in zip(rows, (docs[d], start, length, piece, len(ids[d]) // 4, base + number, at)):
                    rows[name].append(value)
                at += length
        types = {n: pa.binary() if n == "ids" else pa.int64() for n in rows}
        return pa.table({n: pa.array(v, type=types[n]) for n, v in rows.items()})

    return run


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    end_id: int = 1,
    group_docs: int = GROUP_DOCS,
    group_bytes: int = GROUP_BYTES,
    least_gap: int = 16,
    seed: int = 0,
) -> DataFrame:
    """Every token of ``docs`` (doc_id, text) in sequences of at most ``capacity`` tokens.

    Documents are dealt by a hash to groups of about ``group_docs`` or, where
    they are long, ``group_bytes`` of text; each group is packed by itself, so
    the work is one shuffle and no task sees more than a group.  Columns: doc_id, start, length, ids (the piece's ids, unsigned
    32-bit little-endian), doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone; a null doc_id stays null; repeated
    rows are packed as often as they occur; equal lengths keep the order of
    doc_id; an empty table gives no rows.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = picked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-size["n"] // group_docs), -(-size["bytes"] // group_bytes))
    keyed = picked.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")))
    ids = keyed.mapInArrow(_tokenize(vocabulary, end_id, groups), "doc_id long, _group long, ids binary")
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return ids.groupBy("_group").applyInArrow(_pack(capacity, least_gap), schema)
