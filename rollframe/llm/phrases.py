"""Phrase collocations by dynamic itemset counting: cyclic scans of shards in which all phrase lengths are counted at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, forget
from .common import Powers, Words, mix, received, send

LONGEST = 4
LEAST = 30
SHARDS = 2
CELL_BITS = 24
BLOCK_BYTES = 1 << 20
NEVER = 255
SCHEMA = "lang long, phrase string, code int, n long"
#: A phrase's code: its number of words, the step since which it is active (+ 1) in the low bits, and whether it has reached the threshold.
SINCE_BITS = 9
REACHED = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE, _BREAK = 32, 10
#: Each byte as the words see it: A-Z in lower case, the marks that end a piece as a line feed.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[ord(c) for c in ".,;:!?"]] = _BREAK
_ENDS_PIECE = np.zeros(256, dtype=bool)
_ENDS_PIECE[10:14] = True
_GAP = _ENDS_PIECE.copy()
_GAP[[9, _SPACE]] = True


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of folded text as (first document, one past the last, begin, end, seen): ``seen`` leading words were in the last block.

    Documents come whole, about ``limit`` bytes of them; a longer one is cut
    between words, and the next stretch begins ``overlap`` words earlier.
    """
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        begin, stop = int(offsets[at]), int(offsets[to])
        if stop - begin <= limit:
            yield at, to, begin, stop, 0
        else:
            from_, seen = begin, 0
            while from_ < stop:
                end = min(stop, max(begin, from_) + limit)
                while end < stop:  # on to the next gap
                    gap = np.flatnonzero(_GAP[data[end : end + 4096]])
                    end = end + int(gap[0]) + 1 if len(gap) else min(stop, end + 4096)
                    if len(gap):
                        break
                yield at, to, from_, end, seen
                if end == stop:
                    break
                solid = ~_GAP[data[from_:end]]
                starts = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
                back = starts[-overlap:] if overlap else starts[:0]
                seen = len(back)
                begin, from_ = end, from_ + int(back[0]) if seen else end
        at = to


class Block:
    """The words of a stretch, which pieces they are in, and the keys of the phrases that begin at each word."""

    def __init__(self, data: np.ndarray, seen: int, bounds: np.ndarray, langs: np.ndarray, powers: Powers) -> None:
        self.words, self.seen = Words(0, data, np.array([0, len(data)]), powers, False), seen
        self.langs = langs[np.searchsorted(bounds, self.words.starts, "right") - 1]
        self.piece = np.cumsum(_ENDS_PIECE[data], dtype=np.int32)[self.words.starts]
        self.line = None
        self.sums = np.zeros(0, dtype=np.uint64)

    def keys(self, k: int) -> np.ndarray:
        """Keys of the ``k`` words from each word on; called with k = 1, 2, ... in turn."""
        h = self.words.hashes
        n = max(0, len(h) - k + 1)
        self.sums = h.copy() if k == 1 else self.sums[:n] * _ODD + h[k - 1 :]
        return mix(self.sums + self.langs[:n] + np.uint64(k))

    def whole(self, k: int) -> np.ndarray:
        """Whether the ``k`` words from each word on are in one piece and not all of an earlier block."""
        n = max(0, len(self.piece) - k + 1)
        return (self.piece[:n] == self.piece[k - 1 :]) & (np.arange(n) + k > self.seen)

    def _lay_out(self) -> None:
        """The words one after the other, each with one space behind it: only blocks with phrases to name need it."""
        data, ends = self.words.data, self.words.ends
        size = ends - self.words.starts
        self.begin = np.cumsum(size + 1) - size - 1
        self.end = self.begin + size
        solid = ~_GAP[data]
        after = np.zeros(len(data) + 1, dtype=bool)
        after[ends] = True
        line = np.where(solid, data, _SPACE).astype(np.uint8)
        self.line = line[solid | after[:-1]]

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The ``k`` words from each of the given words on, joined by one space."""
        if self.line is None:
            self._lay_out()
        begin, size = self.begin[at], self.end[at + k - 1] - self.begin[at]
        upto = np.r_[0, np.cumsum(size)]
        place = np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)
        text = pa.py_buffer(self.line[place].tobytes())
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(upto.astype(np.int64).tobytes()), text).cast(pa.string())


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each of the distinct keys, and how often it occurs; any place does, so the sort needn't be stable."""
    order = keys.argsort()
    along = keys[order]
    begin = np.flatnonzero(np.r_[True, along[1:] != along[:-1]])
    return order[begin], np.diff(np.r_[begin, len(keys)])


def _code(words: int, since: np.ndarray) -> np.ndarray:
    return ((words << SINCE_BITS) + since + 1).astype(np.int32)


def _count(step: int, shards: int, longest: int, bits: int, sent, limit: int):
    """Counts, block by block, of the phrases that are active in this step."""

    def rows(langs: np.ndarray, phrases: pa.Array, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(langs.view(np.int64)), phrases, pa.array(code), pa.array(n.astype(np.int64))], names=["lang", "phrase", "code", "n"]
        )

    def run(batches):
        reached, powers = np.frombuffer(zlib.decompress(received(sent)), dtype=np.uint8), Powers()
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            _, raw, buffer = texts.buffers()
            offsets = np.frombuffer(raw, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            if not len(texts):
                continue
            data = _FOLD[np.frombuffer(buffer, dtype=np.uint8)]
            of_row = batch.column("lang").to_numpy().view(np.uint64)
            for at, to, begin, end, seen in blocks(data, offsets, limit, longest - 1):
                inside = np.clip(offsets[at : to + 1], begin, end)
                block = Block(data[begin:end], seen, inside - begin, of_row[at:to], powers)
                since = np.full(len(block.words.hashes), -1, dtype=np.int16)
                if step < shards:
                    langs, n = np.unique(block.langs[seen:], return_counts=True)
                    yield rows(langs, pa.array([""] * len(n), type=pa.string()), _code(0, np.full(len(n), -1)), n)
                for k in range(1, longest + 1):
                    keys = block.keys(k)
                    if step < k * shards:  # later all cycles of k words are over: what the map still shows can't be frequent
                        if k > 1:  # both phrases of a word less have reached the threshold
                            since = np.maximum(known_at[:-1], known_at[1:])
                        found = np.flatnonzero(block.whole(k) & (since < step) & (step <= since + shards))
                        if len(found):
                            first, n = _distinct(keys[found])
                            first = found[first]
                            yield rows(block.langs[first], block.phrases(first, k), _code(k, since[first]), n)
                    if step == 0:  # the map is empty
                        break
                    if k < longest and step < (k + 1) * shards:
                        known_at = reached[(keys >> np.uint64(64 - bits)).astype(np.int64)].astype(np.int16)

    return run


def _cells(longest: int, bits: int):
    """The cells of phrases: what ``_count`` looks up for their words in a text."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            words = batch.column("words").to_numpy()
            lines = pa.array([p + "\n" for p in batch.column("phrase").to_pylist()], type=pa.large_string())
            offsets, data = (np.frombuffer(b, dtype=t) for b, t in zip(lines.buffers()[1:], (np.int64, np.uint8)))
            block = Block(data, 0, offsets[: len(lines) + 1], batch.column("lang").to_numpy().view(np.uint64), powers)
            first, cell = np.searchsorted(block.words.starts, offsets[: len(lines)]), np.zeros(len(lines), dtype=np.int64)
            for k in range(1, longest):
                keys, own = block.keys(k), words == k
                cell[own] = (keys[first[own]] >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell)], names=["cell"])

    return run


def _new_cells(phrases: DataFrame, longest: int, bits: int) -> np.ndarray:
    """Numbers of the cells of phrases: a bit map built where the phrases are, of a size that ``bits`` fixes."""
    table = phrases.select("lang", "phrase", "words").mapInArrow(_cells(longest, bits), "cell long")
    number = F.col("cell") + 1
    maps = table.groupBy(F.bitmap_bucket_number(number).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("map"))
    out = np.zeros(1 << max(bits, 15), dtype=bool)
    for row in maps.collect():
        begin = (row["at"] - 1) << 15
        out[begin : begin + (1 << 15)] = np.unpackbits(np.frombuffer(row["map"], dtype=np.uint8), bitorder="little")
    return np.flatnonzero(out)


def frequent_phrases(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shards: int = SHARDS, bits: int = CELL_BITS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """All phrases of up to ``longest`` words with ``least`` occurrences or more per language of ``docs`` (text, lang).

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends,
    and those into words at spaces and tabs; occurrences lie within a piece and
    may overlap.  Columns: lang (null: ``und``), phrase (joined by one space),
    words, n; a row with no words holds a language's number of words.

    Documents are dealt to ``shards``; each step scans the next one, in a
    circle.  Words are active from the start; a longer phrase becomes active
    after the step in which both its phrases of a word less have ``least``
    occurrences, and is counted, among all lengths that are active by then, in
    the next ``shards`` steps, one full cycle.  So counts are exact, and a step
    carries on only those phrases whose cycle isn't over.  Words are counted by
    step ``shards`` - 1, so phrases of k words by step k * ``shards`` - 1.

    What is active is told by a map with 2^``bits`` cells, each holding the
    step in which a phrase of that hash reached the threshold first: one byte a
    cell, broadcast in compressed form, whatever the size of the data.  Phrases that share a cell
    are counted too early at worst, but for a full cycle all the same.

    A null or empty text has no words; repeated rows count as often as they
    occur; an empty table gives no rows.  A text is read in blocks that overlap
    by ``longest`` - 1 words, so its length has no bound.  Within a block equal
    phrases are found by a 64-bit hash, across blocks by their words.
    """
    if longest * shards >= NEVER:
        raise ValueError("too many steps for a byte")
    spark = docs.sparkSession
    name = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    text = F.concat(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\n"))
    rows = docs.select(text.alias("text"), F.xxhash64(name).alias("lang")).where("text <> '\n'")
    names = docs.select(F.xxhash64(name).alias("_lang"), name.alias("lang")).distinct()
    dealt = cut(rows.withColumn("shard", F.pmod(F.xxhash64("text", "lang"), F.lit(shards)).cast("int")), "shard")
    reached = np.full(1 << bits, NEVER, dtype=np.uint8)
    code, was = F.col("code"), F.col("code") >= REACHED
    words, since = F.shiftright(code, SINCE_BITS) % (REACHED >> SINCE_BITS), code % (1 << SINCE_BITS) - 1
    state, open_, complete, step, last = None, None, [], 0, -1
    while step <= last + shards:
        sent = send(spark, zlib.compress(reached.tobytes(), 1))
        found = dealt.where(F.col("shard") == step % shards).select("lang", "text")
        found = found.mapInArrow(_count(step, shards, longest, bits, sent, block_bytes), SCHEMA)
        every = found if open_ is None else found.unionByName(open_)
        over = since + shards <= step
        counted = every.groupBy("lang", "phrase").agg(F.max("code").alias("code"), F.sum("n").alias("n"))
        counted = counted.where(~over | (F.col("n") >= least) | (words == 0)).withColumn("over", over)
        before, state = state, cut(counted, "over")
        sent.destroy()  # the step is written, and what the last one left open is read
        if before is not None:
            forget(before, "over=false")
        new = state.where(words.between(1, longest - 1) & (F.col("n") >= least) & ~was).select("lang", "phrase", words.alias("words"))
        cells = _new_cells(new, longest, bits)
        cells = cells[reached[cells] == NEVER]
        if len(cells):
            reached[cells] = step
            last = step
        complete.append(state.where("over").select(F.col("lang").alias("_lang"), "phrase", words.alias("words"), "n"))
        marked = F.when((F.col("n") >= least) & ~was, code + REACHED).otherwise(code).alias("code")
        open_ = state.where("NOT over").select("lang", "phrase", marked, "n")
        step += 1
    return reduce(DataFrame.unionByName, complete).join(names, "_lang").select("lang", "phrase", "words", "n")


def collocations(phrases: DataFrame, keep: int = 2000, share: tuple[int, int] = (80, 100), scale: int = 2_000_000) -> DataFrame:
    """The phrases of two words and more of ``phrases`` (lang, phrase, words, n, as counted above) that hold together best, per lang.

    A phrase cut in two has the score floor(scale * a / (l + r)) of its count
    and those of its parts; its lowest-scoring cut counts (ties: the first).
    Phrases inside a longer one that has ``share`` of their count or more are
    left out.  The first ``keep`` by score, count (both falling) and phrase.

    Columns: lang, rank, phrase, a, l, r, n (words of the language), score.
    Scores are worked out in decimals of 38 places.
    """
    counted = phrases.where("words > 0")
    joint = counted.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = joint.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    part = lambda name, n: counted.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr(f"cast(cast(a AS decimal(20, 0)) * {scale} div (cast(l AS decimal(20, 0)) + r) AS bigint)"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    word = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.array_join(F.slice(word, at, size), " "))))
    longer = joint.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    inside = F.expr(f"cast(longer AS decimal(20, 0)) * {share[1]} >= cast(a AS decimal(20, 0)) * {share[0]}")
    kept = scored.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(inside, F.lit(False)))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= keep)
    total = phrases.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
