"""Substring dedup: suffix automata of reference shards, matching statistics of the texts streamed past them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import Powers, Words, mix, read_words, row_key, shard_count

WINDOW = 13
ANCHOR = 5
SHARD_BYTES = 16 << 20
HOT = 2000
ENTRIES = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
#: Windows whose anchors are found at once: their words' places fit beside the hash.
STRETCH = 1 << 22


class SuffixAutomaton:
    """All substrings of the texts added so far, over words, and the first document each stands in.

    Texts are added in rising order of document, so the document that makes a
    state is the smallest of its occurrences, and a clone keeps it.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def add(self, words: list, doc) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word, doc)

    def _extend(self, last: int, word, doc) -> int:
        step = self.next[last].get(word)
        if step is not None:
            if self.length[step] == self.length[last] + 1:
                return step
            return self._clone(last, step, word)
        made = self._state({}, self.length[last] + 1, doc)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = made
            last = self.link[last]
        if last < 0:
            self.link[made] = 0
        else:
            step = self.next[last][word]
            self.link[made] = step if self.length[step] == self.length[last] + 1 else self._clone(last, step, word)
        return made

    def _state(self, edges: dict, length: int, doc) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        self.first.append(doc)
        return len(self.next) - 1

    def _clone(self, last: int, step: int, word) -> int:
        copy = self._state(dict(self.next[step]), self.length[last] + 1, self.first[step])
        self.link[copy], self.link[step] = self.link[step], copy
        while last >= 0 and self.next[last].get(word) == step:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def windows_before(self, words: list, doc, size: int) -> list[int]:
        """Starts of the windows of ``size`` words that stand in a document before ``doc``, by matching statistics."""
        state = matched = 0
        found = []
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            if matched >= size:
                # the state of the last ``size`` words alone, which may occur earlier than the longer match
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                matched = min(matched, self.length[state])
                if self.first[state] < doc:
                    found.append(i - size + 1)
        return found


def anchors(words: Words, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``k`` words from each word on; the starts of all windows; each window's anchor.

    The anchor of a window is where its smallest hash begins (leftmost of
    equals): equal windows have equal anchors, wherever they stand.
    """
    grams, _ = words.grams(k)
    n = len(grams) - size + 1
    if n <= 0:
        return grams, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    place, reach = np.empty(n, dtype=np.int64), size - k + 1
    for a in range(0, n, STRETCH):
        part = grams[a : a + STRETCH + reach - 1]
        least, step = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64), 1
        while step * 2 <= reach:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if reach > step:
            least = np.minimum(least[: -(reach - step)], least[reach - step :])
        place[a : a + STRETCH] = a + (least[: min(STRETCH, n - a)] & _PLACE).astype(np.int64)
    ends = np.repeat(words.bounds[1:], np.diff(words.bounds))
    starts = np.flatnonzero(np.arange(n) + size <= ends[:n])
    return grams, starts, place[starts]


def _code(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and 32-bit name of hashes; two hashes with one name only meet in vain."""
    return ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int64), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _owners(words: Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.bounds, at, "right") - 1


def _name_anchors(size: int, k: int, shards: int):
    """Every anchor with its document, to the anchor's shard."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            ids, homes = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("shard").to_numpy(zero_copy_only=False)
            shard, parts = [], [[], [], []]
            for words in read_words(batch.column("text"), powers):
                grams, _, place = anchors(words, size, k)
                place = place[np.r_[True, place[1:] != place[:-1]]] if len(place) else place
                own = _owners(words, place) + words.first
                where, name = _code(grams[place], shards)
                shard.append(where)
                for part, values in zip(parts, (name, ids[own].astype("<i8"), homes[own].astype("<u4"))):
                    part.append(values)
            if shard:
                yield blobs.pack(np.concatenate(shard), [np.concatenate(p) for p in parts])

    return run


def _share(batches):
    """Anchors that stand in more than one document, to the homes of all documents that have them."""
    kinds = ["<u4", "<i8", "<u4"]
    for shard, held in blobs.by_shard(batches):
        known: list[np.ndarray] = []

        def merged(more: list) -> list[np.ndarray]:
            name, low, high, count = (np.concatenate([m[i] for m in more]) for i in range(4))
            order = np.argsort(name, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(name[order]) != 0])
            reduce = lambda f, x: f.reduceat(x[order], at)
            return [name[order][at], reduce(np.minimum, low), reduce(np.maximum, high), reduce(np.add, count)]

        for blob in held:
            name, doc, _ = blobs.unpack(blob, kinds)
            new = merged([[name, doc, doc, np.ones(len(name), dtype=np.int64)]])
            known = merged([known, new]) if known else new
        both = known[1] < known[2]
        names, counts = known[0][both], known[3][both]
        if not len(names):
            continue
        ready, size = [], 0
        for number, blob in enumerate(held, 1):
            name, doc, home = blobs.unpack(blob, kinds)
            at = np.minimum(np.searchsorted(names, name), len(names) - 1)
            hit = names[at] == name
            code = (np.uint64(shard) << np.uint64(32)) | name[hit].astype(np.uint64)
            ready.append((home[hit].astype(np.int64), doc[hit], code, (counts[at[hit]] > HOT).astype(np.uint8)))
            size += len(code)
            if size and (size >= ENTRIES or number == len(held)):
                home, *columns = (np.concatenate(c) for c in zip(*ready))
                yield blobs.pack(home, columns)
                ready, size = [], 0


def _pair(doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(mix(doc.astype(np.int64).view(np.uint64)) ^ code)


def _cut_pieces(size: int, k: int, shards: int):
    """The stretch of words around each shared anchor, to the anchor's shard.

    A piece covers all windows of one anchor.  Around anchors of more than
    ``HOT`` documents each window is a piece of its own and goes to the shard
    of its own hash, which spreads them.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        powers = Powers()
        out, texts = [], []
        if left.num_rows and right.num_rows:
            got = [blobs.unpack(b, ["<i8", "<u8", "u1"]) for b in right.column("blob").to_pylist()]
            pairs = _pair(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
            hot = np.concatenate([g[2] for g in got])
            order = np.argsort(pairs)
            pairs, hot = pairs[order], hot[order]
            ids, keys = (pc.fill_null(left.column(c).combine_chunks(), 0).to_numpy(zero_copy_only=False) for c in ("doc_id", "row_key"))
            real = left.column("doc_id").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            home = left.column("shard")[0].as_py()
            for words in read_words(left.column("text").combine_chunks(), powers):
                grams, starts, place = anchors(words, size, k)
                own = _owners(words, starts) + words.first
                where, name = _code(grams[place], shards)
                pair = _pair(ids[own], (where.astype(np.uint64) << np.uint64(32)) | name)
                at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                keep = (pairs[at] == pair) & real[own]
                starts, place, own, spread = starts[keep], place[keep], own[keep], hot[at[keep]] > 0
                where, name = where[keep], name[keep]
                if not len(starts):
                    continue
                alone, _ = words.grams(size)
                where[spread], name[spread] = _code(alone[starts[spread]], shards)
                first = np.r_[True, (place[1:] != place[:-1]) | spread[1:]]
                begin = np.flatnonzero(first)
                last = np.r_[begin[1:], len(starts)] - 1
                a, b = starts[begin], starts[last] + size
                raw = words.data.tobytes()
                texts += [raw[x:y] for x, y in zip(words.starts[a].tolist(), words.ends[b - 1].tolist())]
                row = own[begin]
                start = (a - words.bounds[row - words.first]).astype("<u4")
                out.append((where[begin], name[begin], ids[row].astype("<i8"), keys[row].astype("<i8"), start, np.full(len(a), home, dtype="<u4")))
        schema = pa.schema([("shard", pa.int32()), ("blob", pa.binary())])
        if not out:
            return schema.empty_table()
        where, *columns = (np.concatenate(c) for c in zip(*out))
        return pa.Table.from_batches([blobs.pack(where, columns, texts)], schema=schema)

    return run


def repeated_windows(pieces: list[tuple[int, bytes]], size: int) -> list[list[int]]:
    """For (document, words) pieces of one anchor in rising order of document: the windows that stand in an earlier one.

    Equal pieces are streamed once: a copy in a later document is all repeated.
    The automaton takes a piece in when another follows that differs from it.
    """
    first: dict[bytes, tuple[int, list[int], int]] = {}
    automaton, waiting, out = SuffixAutomaton(), None, []
    for doc, raw in pieces:
        words = raw.split()
        text = b" ".join(words)
        known = first.get(text)
        if known is None:
            if waiting is not None:
                automaton.add(*waiting)
            starts = automaton.windows_before(words, doc, size) if waiting is not None else []
            waiting = (words, doc)
            known = first[text] = (doc, starts, len(words) - size + 1)
        out.append(list(range(known[2])) if known[0] < doc else known[1])
    return out


def _match(size: int):
    """Runs of repeated windows of every piece, to the home of its document."""

    def run(batches):
        kinds = ["<u4", "<i8", "<i8", "<u4", "<u4"]
        for _, held in blobs.by_shard(batches):
            got = [blobs.unpack(b, kinds, True) for b in held]
            name, doc, key, start, home = (np.concatenate([g[i] for g in got]) for i in range(5))
            texts = [t for g in got for t in g[5]]
            order = np.lexsort((key, doc, name))
            name, doc, key, start, home = (x[order] for x in (name, doc, key, start, home))
            begins = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]).tolist()
            docs, places, row, at, run_length = doc.tolist(), order.tolist(), [], [], []
            for a, b in zip(begins, [*begins[1:], len(name)]):
                if docs[a] == docs[b - 1]:
                    continue
                for i, windows in enumerate(repeated_windows([(docs[j], texts[places[j]]) for j in range(a, b)], size), a):
                    if windows:
                        row.append(i)
                        at.append(windows[0])
                        run_length.append(windows[-1] - windows[0] + 1)
                        if run_length[-1] != len(windows):  # not one run
                            run_length[-1] = 1
                            for w in windows[1:]:
                                row.append(i)
                                at.append(w)
                                run_length.append(1)
            if row:
                row = np.array(row)
                columns = [key[row], (start[row] + np.array(at)).astype("<u4"), np.array(run_length, dtype="<u4")]
                yield blobs.pack(home[row].astype(np.int64), columns)

    return run


def _remove(size: int):
    """Words outside all repeated windows, joined by one space."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        powers = Powers()
        n = left.num_rows
        keys = left.column("row_key").combine_chunks().to_numpy(zero_copy_only=False)
        got = [blobs.unpack(b, ["<i8", "<u4", "<u4"]) for b in right.column("blob").to_pylist()]
        key, start, count = (np.concatenate([np.zeros(0, dtype=np.int64), *[g[i] for g in got]]) for i in range(3))
        order = np.argsort(key, kind="stable")
        key, start, count = key[order], start[order], count[order]
        total, removed, kept = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), []
        for words in read_words(left.column("text").combine_chunks(), powers):
            raw = words.data.tobytes()
            sizes = np.diff(words.bounds)
            for i in range(len(words)):
                row, own = words.first + i, raw[words.offsets[i] : words.offsets[i + 1]].split()
                a, b = np.searchsorted(key, keys[row], "left"), np.searchsorted(key, keys[row], "right")
                if a < b:
                    edge = np.zeros(len(own) + 1, dtype=np.int64)
                    np.add.at(edge, start[a:b], 1)
                    np.add.at(edge, start[a:b] + count[a:b] + size - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed[row] = gone.sum()
                    own = [w for w, g in zip(own, gone.tolist()) if not g]
                kept.append(b" ".join(own).decode())
                total[row] = sizes[i]
        return pa.table({
            "doc_id": left.column("doc_id"), "n_words": pa.array(total), "n_removed": pa.array(removed), "kept": pa.array(kept, type=pa.string()),
        })

    return run


def remove_repeats(docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The words of each row of ``docs`` (doc_id, text) without those that repeat an earlier document.

    A word goes if it lies in ``size`` consecutive words of its document that
    also stand, in that order, in a document with a smaller id; that is judged
    on the input.  Columns: doc_id, n_words, n_removed, kept (words joined by
    one space).

    The reference is sharded by content, as windows have equal anchors where
    they are equal: anchors are counted, the words around those that occur in
    two documents or more go to the anchor's shard, and there each piece runs
    through the suffix automaton of the pieces of smaller ids.  So a text only
    meets the automata that can hold its windows.  The texts themselves are
    shuffled once, by document.

    Null and empty texts have no words; texts may be of any length; a null
    doc_id repeats nothing and is repeated by nothing; rows with one id never
    repeat each other; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shards = shard_count(rows, SHARD_BYTES)
    home = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")
    rows = rows.select(home, "doc_id", row_key("doc_id", "text").alias("row_key"), "text")
    named = rows.where("doc_id IS NOT NULL").select("shard", "doc_id", "text")
    to_shard = lambda df: df.repartition("shard").sortWithinPartitions("shard")
    shared = to_shard(named.mapInArrow(_name_anchors(size, anchor, shards), blobs.SCHEMA)).mapInArrow(_share, blobs.SCHEMA)
    at_home = rows.groupBy("shard")
    pieces = at_home.cogroup(shared.groupBy("shard")).applyInArrow(_cut_pieces(size, anchor, shards), blobs.SCHEMA)
    repeats = to_shard(pieces).mapInArrow(_match(size), blobs.SCHEMA)
    schema = "doc_id long, n_words long, n_removed long, kept string"
    return at_home.cogroup(repeats.groupBy("shard")).applyInArrow(_remove(size), schema)
