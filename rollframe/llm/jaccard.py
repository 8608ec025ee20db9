"""N-gram Jaccard join: documents grouped by prefix and size, groups paired by shared prefix shingles, members verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import blobs
from .common import Powers, Words, mix, read_words, received, row_key, send, shard_count, tidy

CELL_BITS = 24
SLICES = 64
SHARD_BYTES = 16 << 20
SITE_MEMBERS = 2048
#: Text whose words and shingles a task holds at once, in bytes.
READ_BYTES = 1 << 18
_SALT = np.uint64(0xA24BAED4963EE407)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, as (text number, hash) sorted by both.

    A text of fewer than ``k`` words has its whole word sequence as its only shingle.
    """
    grams, whole = words.grams(k)
    owner = np.repeat(np.arange(len(words)), np.diff(words.bounds))
    docs, tokens = [owner[whole]], [grams[whole]]
    sizes = np.diff(words.bounds)
    for j in range(1, k):
        short = np.flatnonzero(sizes == j)
        if len(short):
            docs.append(short)
            tokens.append(words.grams(j)[0][words.bounds[short]])
    doc, token = np.concatenate(docs), np.concatenate(tokens)
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return doc[new], token[new]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of the ranges between ``bounds``."""
    upto = np.r_[np.zeros(1, dtype=np.uint64), np.cumsum(values)]
    return upto[bounds[1:]] - upto[bounds[:-1]]


def least_overlap(n, num: int, den: int):
    """The fewest common shingles a set of ``n`` can have with any set it links to."""
    return -(-num * n // den)


def _count_cells(k: int):
    """How many texts of this task have a shingle in each of 2^24 cells, in slices."""

    def run(batches):
        powers, counts = Powers(), np.zeros(1 << CELL_BITS, dtype=np.int32)
        for batch in batches:
            for words in read_words(batch.column("text"), powers, True, READ_BYTES):
                _, token = shingle_sets(words, k)
                cell, n = np.unique(token >> np.uint64(64 - CELL_BITS), return_counts=True)
                counts[cell.astype(np.int64)] += n.astype(np.int32)
        width = (1 << CELL_BITS) // SLICES
        for number, part in enumerate(counts.reshape(SLICES, width)):
            cell = np.flatnonzero(part)
            if len(cell):
                yield blobs.pack(np.full(len(cell), number), [cell.astype("<u4"), part[cell].astype("<u4")])

    return tidy(run)


@tidy
def _levels(batches):
    """The sum of all tasks' counts of a slice, as a logarithm in one byte."""
    for shard, held in blobs.by_shard(batches):
        total = np.zeros((1 << CELL_BITS) // SLICES, dtype=np.int64)
        for blob in held:
            cell, n = blobs.unpack(blob, ["<u4", "<u4"])
            total[cell] += n
        level = np.minimum(255, np.floor(6 * np.log2(1 + total))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([shard], type=pa.int32()), pa.array([level.tobytes()], type=pa.binary())], names=["shard", "blob"])


def frequency_levels(rows: DataFrame, k: int) -> np.ndarray:
    """How frequent shingles are, over all rows: one byte for each of 2^24 cells (16 MB at any input size).

    It only orders shingles, rare ones first; every order gives the same links.
    """
    counted = rows.select("text").mapInArrow(_count_cells(k), blobs.SCHEMA)
    levels = counted.repartition("shard").sortWithinPartitions("shard").mapInArrow(_levels, blobs.SCHEMA)
    out = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    width = len(out) // SLICES
    for r in levels.toLocalIterator():
        out[r["shard"] * width : (r["shard"] + 1) * width] = np.frombuffer(bytes(r["blob"]), dtype=np.uint8)
    return out


def _prefixes(sent, k: int, num: int, den: int):
    """Per row: size and hash of its set, its prefix (the rarest shingles, as many as two linked sets must share one of), and the hash of prefix and size."""

    def run(batches):
        levels, powers = received(sent), Powers()
        for batch in batches:
            n_all, set_all, group_all, prefixes = [], [], [], []
            for words in read_words(batch.column("text"), powers, True, READ_BYTES):
                doc, token = shingle_sets(words, k)
                bounds = np.searchsorted(doc, np.arange(len(words) + 1))
                n = np.diff(bounds)
                order = np.lexsort((token, levels[(token >> np.uint64(64 - CELL_BITS)).astype(np.int64)], doc))
                ranked = token[order]
                length = np.where(n > 0, n - least_overlap(n, num, den) + 1, 0)
                in_prefix = np.arange(len(doc)) - np.repeat(bounds[:-1], n) < np.repeat(length, n)
                prefix = ranked[in_prefix]
                ends = np.r_[0, np.cumsum(length)]
                sets = mix(_sums(mix(token ^ _SALT), bounds) + n.astype(np.uint64))
                groups = mix(_sums(mix(prefix + _SALT), ends) + n.astype(np.uint64) * _SALT)
                raw = prefix.tobytes()
                prefixes += [raw[8 * a : 8 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                n_all.append(n)
                set_all.append(sets.view(np.int64))
                group_all.append(groups.view(np.int64))
            if n_all:
                columns = [pa.array(np.concatenate(x)) for x in (n_all, set_all, group_all)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("row_key"), *columns, pa.array(prefixes, type=pa.binary())],
                    names=["doc_id", "row_key", "n", "set", "group", "prefix"],
                )

    return tidy(run)


def _post(shards: int):
    """Each prefix shingle with its row's size and group, to the shingle's shard."""

    def run(batches):
        for batch in batches:
            parts = batch.column("prefix").to_pylist()
            token = np.frombuffer(b"".join(parts), dtype="<u8")
            times = [len(p) // 8 for p in parts]
            n = np.repeat(batch.column("n").to_numpy(zero_copy_only=False), times)
            group = np.repeat(batch.column("group").to_numpy(zero_copy_only=False), times)
            shard = ((token >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
            if len(token):
                yield blobs.pack(shard, [(token & np.uint64(0xFFFFFFFF)).astype("<u4"), n.astype("<u4"), group.astype("<i8")])

    return tidy(run)


def _sites(num: int, den: int, most: int):
    """Groups that share a prefix shingle, as (group, site): all of a site are to be compared.

    Along the sizes, a run of groups ends where the next size is too large for
    any link.  A run of more than ``most`` groups is cut into blocks and every
    two blocks are a site, so no site is larger whatever a shingle's frequency.
    """

    def run(batches):
        for _, held in blobs.by_shard(batches):
            got = [blobs.unpack(b, ["<u4", "<u4", "<i8"]) for b in held]
            name, n, group = (np.concatenate([g[i] for g in got]) for i in range(3))
            order = np.lexsort((group, n, name))
            name, n, group = name[order], n[order].astype(np.int64), group[order]
            new = np.r_[True, (name[1:] != name[:-1]) | (group[1:] != group[:-1])]
            name, n, group = name[new], n[new], group[new]
            begin = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (n[:-1] * den < n[1:] * num)])
            size = np.diff(np.r_[begin, len(name)])
            least = np.minimum.reduceat(group, begin)
            small = np.repeat((size > 1) & (size <= most), size)
            members, sites = [group[small]], [np.repeat(least, size)[small]]
            for i in np.flatnonzero(size > most):
                own = group[begin[i] : begin[i] + size[i]]
                blocks = np.array_split(own, -(-len(own) // (most // 2)))
                for x in range(len(blocks)):
                    for y in range(x + 1, len(blocks)):
                        both = np.r_[blocks[x], blocks[y]]
                        pair = mix(np.array([least[i]], dtype=np.int64).view(np.uint64) + np.uint64(x * len(blocks) + y + 1))
                        members.append(both)
                        sites.append(np.repeat(pair.view(np.int64), len(both)))
            members, sites = np.concatenate(members), np.concatenate(sites)
            if len(members):
                yield pa.RecordBatch.from_arrays([pa.array(members), pa.array(sites)], names=["group", "site"])

    return tidy(run)


def links_within(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join the linked ones of ``sets`` (sorted, distinct hashes): a spanning forest.

    Each set is first held against one set of the only class so far, if there is
    only one; else its common shingles with all earlier sets are counted at
    once from the list of sets that each shingle is in.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)

    def linked(common, a, b):
        return den * common >= num * (a + b - common)

    if m == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if linked(common, sizes[0], sizes[1]) else []
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    owner = np.repeat(np.arange(m), sizes)[order]
    first = np.r_[True, token[order][1:] != token[order][:-1]]
    begin = np.flatnonzero(first)
    count = np.diff(np.r_[begin, len(token)])
    number = np.empty(len(token), dtype=np.int64)
    number[order] = np.cumsum(first) - 1
    bounds = np.r_[0, np.cumsum(sizes)]
    label, classes, out = np.zeros(m, dtype=np.int64), 1, []
    next_label, probe = 1, 0
    for i in range(1, m):
        if classes == 1:
            common = len(np.intersect1d(sets[i], sets[probe], assume_unique=True))
            if linked(common, sizes[i], sizes[probe]):
                label[i] = label[probe]
                out.append((probe, i))
                continue
        own = number[bounds[i] : bounds[i + 1]]
        times = count[own]
        upto = np.cumsum(times)
        place = np.arange(upto[-1]) + np.repeat(begin[own] - (upto - times), times)
        common = np.bincount(owner[place], minlength=m)[:i]
        near = np.flatnonzero(linked(common, sizes[i], sizes[:i]))
        label[i], next_label = next_label, next_label + 1
        classes += 1
        for j in near.tolist():
            if label[j] != label[i]:
                label[:i][label[:i] == label[j]] = label[i]
                classes -= 1
                out.append((j, i))
    return out


def _verify(k: int, num: int, den: int):
    """Links among the sets of each site, from rows (site, set, text) sorted by site."""

    def members(batches):
        site, held = None, {}
        for batch in batches:
            for s, h, text in zip(batch.column("site").to_pylist(), batch.column("set").to_pylist(), batch.column("text").to_pylist()):
                if s != site and held:
                    yield held
                    held = {}
                site = s
                held[h] = text
        if held:
            yield held

    def run(batches):
        powers = Powers()
        left, right = [], []
        for held in members(batches):
            if len(held) > 1:
                names, sets = sorted(held), []
                for words in read_words(pa.array([held[h] for h in names], type=pa.string()), powers, True, READ_BYTES):
                    doc, token = shingle_sets(words, k)
                    bounds = np.searchsorted(doc, np.arange(len(words) + 1))
                    sets += [token[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                for a, b in links_within(sets, num, den):
                    left.append(names[a])
                    right.append(names[b])
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, type=pa.int64()), pa.array(right, type=pa.int64())], names=["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, type=pa.int64()), pa.array(right, type=pa.int64())], names=["a", "b"])

    return tidy(run)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node with a link to another: node, label.

    Large and small stars in turn: each node's larger neighbours, then its
    smaller ones, are hung on the smallest of them, until nothing changes.
    Minima are aggregates joined back, so a node of any degree is split.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Classes of ``docs`` (doc_id, text) under links of Jaccard similarity ``num`` / ``den`` or more.

    Texts are lower-cased (A-Z) and cut into words; a row's set holds its
    distinct ``shingle``-word shingles, as 64-bit hashes.  Rows with one set are
    one node, sets with one prefix and size one group.  Groups that share a
    prefix shingle meet at a site, where the texts of their sets are compared
    in full; the classes come from all links found.

    Columns: doc_id, n_shingles, component_id (smallest doc_id of the class),
    set (the class's smallest set, null for rows without words), row_key.  Null
    and blank texts have no shingles and are linked with nothing; a null doc_id
    counts as no id in the minimum; repeated rows are of one class; an empty
    table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", row_key("doc_id", "text"))
    shards = shard_count(rows, SHARD_BYTES)
    sent = send(docs.sparkSession, frequency_levels(rows, shingle))
    schema = "doc_id long, row_key long, n long, set long, group long, prefix binary"
    known = cut(rows.select("doc_id", "row_key", "text").mapInArrow(_prefixes(sent, shingle, num, den), schema))
    real = known.where("n > 0")
    posted = real.select("n", "group", "prefix").mapInArrow(_post(shards), blobs.SCHEMA)
    posted = posted.repartition("shard").sortWithinPartitions("shard")
    sites = posted.mapInArrow(_sites(num, den, SITE_MEMBERS), "group long, site long").distinct()
    # one row stands for a set; groups of several sets are sites of their own
    sets = real.groupBy("group", "set").agg(F.min(F.struct("row_key", "doc_id")).alias("row"))
    several = sets.groupBy("group").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("group", F.col("group").alias("site"))
    asked = sets.join(sites.unionByName(several).distinct(), "group").select("site", "set", F.col("row.row_key").alias("row_key")).distinct()
    texts = rows.select("row_key", "text").join(asked, "row_key").select("site", "set", "text")
    texts = texts.repartition("site").sortWithinPartitions("site", "set")
    links = texts.mapInArrow(_verify(shingle, num, den), "a long, b long")
    labels = components(links)
    out = real.select("doc_id", "row_key", "n", "set").join(labels, F.col("set") == F.col("node"), "left")
    out = out.withColumn("label", F.coalesce("label", "set"))
    least = out.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = out.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("label").alias("set"), "row_key")
    none = known.where("n = 0")
    return out.unionByName(none.select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("set"), "row_key"
    ))
