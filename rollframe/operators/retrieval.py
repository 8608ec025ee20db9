"""Nearest passages by inverted lists: documents grouped around coarse centroids, queries sent to the lists they probe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..functions.exprs import hash_unit
from ..session import cut

MOST_LISTS = 1024
SAMPLE = 65_536
TRAIN_TASKS = 8
#: What rounding can do to the cosine of an angle that was itself computed.
SLACK = 1e-7
FOUND = "query_id bigint, doc_id bigint, score double"
#: Similarities, angles to centroids, and pairs measured in double precision, that a task holds at once.
PAIRS, ASKED, MEASURED = 1 << 21, 1 << 20, 1 << 16
#: Queries compared at once, and the most blocks of queries that a task gets.
QUERIES, PART_BLOCKS = 1024, 8


def unit_rows(vectors) -> np.ndarray:
    """Vectors of one length as rows of length 1; zero stays zero."""
    m = np.asarray(vectors if isinstance(vectors, np.ndarray) else np.stack(list(vectors)), dtype="float64")
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of vectors of one length as rows; a missing number is NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, n = column.flatten().to_numpy(zero_copy_only=False), len(column)
    if (column.value_lengths().to_numpy() * n != len(flat)).any():
        raise ValueError("all vectors must have the same length")
    return flat.reshape(n, -1) if n else flat.reshape(0, 1)


def _vectors(vector: str, df: DataFrame) -> tuple[Column, str]:
    """A column of vectors and its type: floats as they are, other numbers as double."""
    kind = "array<float>" if isinstance(df.schema[vector].dataType.elementType, FloatType) else "array<double>"
    return F.col(vector).cast(kind), kind


def angles(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centroids.T, -1, 1))


class Lists:
    """Centroids, and of each list its number of documents and its widest angle: at most ``MOST_LISTS`` rows, whatever the data."""

    def __init__(self, centroids: np.ndarray, size: np.ndarray, radius: np.ndarray) -> None:
        self.centroids, self.size, self.radius = centroids, size, radius

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """No document of a list has a higher cosine with the query; empty lists have none."""
        reach = np.cos(np.maximum(0, angles(unit, self.centroids) - self.radius)) + SLACK
        return np.where(self.size > 0, reach, -np.inf)

    def nearest(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` lists to read first, as marks per query and list."""
        order = np.argsort(np.where(self.size > 0, angles(unit, self.centroids), np.inf), axis=1, kind="stable")[:, :probes]
        marks = np.zeros((len(unit), len(self.size)), dtype=bool)
        np.put_along_axis(marks, order, True, axis=1)
        return marks & (self.size > 0)


def train_centroids(docs: DataFrame, n: int, n_lists: int, vector: str, id_col: str, steps: int = 3, sample: int = SAMPLE, seed: int = 0) -> np.ndarray:
    """Directions of ``n_lists`` groups of documents, by ``steps`` Lloyd steps on cosine over a sample.

    The sample, about ``sample`` of the ``n`` rows chosen by a hash of their
    ids, is the only bounded read; every document is listed afterwards.  A step
    sums directions per list in at most ``TRAIN_TASKS`` tasks, and those sums
    come to the driver.
    """
    picked = docs.select(F.col(vector).alias("v"), hash_unit(id_col, seed=seed).alias("u"))
    rows = cut(picked.where(F.col("u") < sample / n).coalesce(TRAIN_TASKS))
    centroids = unit_rows([r["v"] for r in rows.orderBy("u", "v").limit(n_lists).collect()])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(centroids)
        for batch in batches:
            if batch.num_rows:
                unit = unit_rows(matrix(batch.column("v")))
                np.add.at(total, (unit @ centroids.T).argmax(1), unit)
        have = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_pydict({"list": pa.array(have, pa.int64()), "total": pa.array(total[have].tolist(), pa.list_(pa.float64()))})

    for _ in range(steps):
        moved = np.zeros_like(centroids)
        for r in rows.select("v").mapInArrow(assign, "list bigint, total array<double>").collect():
            moved[r["list"]] += np.array(r["total"])
        length = np.linalg.norm(moved, axis=1, keepdims=True)
        centroids = np.where(length > 0, moved / np.maximum(length, 1e-300), centroids)
    return centroids


def list_documents(docs: DataFrame, centroids: np.ndarray, vector: str, id_col: str) -> tuple[DataFrame, Lists]:
    """Every document with the list of its nearest centroid, written once, and what the lists hold."""

    step = max(1, ASKED // len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                away = angles(unit_rows(matrix(batch.column("dv"))), centroids)
                near = away.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(away[np.arange(len(near)), near])], ["did", "dv", "list", "angle"])

    dv, kind = _vectors(vector, docs)
    d = docs.select(F.col(id_col).cast("long").alias("did"), dv.alias("dv"))
    listed = cut(d.mapInArrow(run, f"did bigint, dv {kind}, list bigint, angle double"))
    size, radius = np.zeros(len(centroids), dtype="int64"), np.zeros(len(centroids))
    for r in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect():
        size[r["list"]], radius[r["list"]] = r["n"], r["r"]
    return listed, Lists(centroids, size, radius)


def block_lists(size: np.ndarray, doc_block: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of each list its first block and its number of blocks; of each block its lists, from the first to before the last.

    Neighbouring lists share a block of at most ``doc_block`` documents; a longer list has several blocks of its own.
    """
    first, own = np.zeros(len(size), dtype="int64"), np.maximum(1, -(-size // doc_block))
    ranges, filled = [], doc_block + 1
    for i, n in enumerate(size.tolist()):
        if own[i] > 1 or filled + n > doc_block:
            first[i], filled = len(ranges), n
            ranges += [(i, i + 1)] * int(own[i])
        else:
            first[i], filled = len(ranges) - 1, filled + n
            ranges[-1] = (ranges[-1][0], i + 1)
    return first, own, ranges


class _Block:
    """Documents of a block by list, and what queries find there.

    Similarities are single precision and only tell which pairs can be among the
    nearest; those are measured in double precision, each by itself, so that
    equal documents have equal scores.
    """

    def __init__(self, docs: pa.Table, lists: tuple[int, int], k: int, exclude_self: bool) -> None:
        raw, self.k, self.exclude_self = matrix(docs["dv"]), k, exclude_self
        known = docs["did"].is_valid().to_numpy()
        did, at = docs["did"].fill_null(np.iinfo("int64").max).to_numpy(), docs["list"].to_numpy()
        # a query's own rows may be the first of equal vectors
        rows = np.unique(did[known], return_counts=True)[1].max(initial=0) if exclude_self else 0
        keep = np.flatnonzero(np.isfinite(raw).all(axis=1))
        keep = keep[self._needed(raw[keep], did[keep], at[keep], k + int(rows))]
        self.rows = keep[np.lexsort((did[keep], at[keep]))]
        self.did, self.known, self.unit = did[self.rows], known[self.rows], unit_rows(raw[self.rows])
        self.rough, self.bounds = self.unit.astype("float32"), np.searchsorted(at[self.rows], np.arange(lists[0], lists[1] + 1))
        #: What single precision can do to the difference of two similarities.
        self.slack = np.float32((raw.shape[1] + 8) * 2.0**-23)

    @staticmethod
    def _needed(raw: np.ndarray, did: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
        """All rows but those behind the first ``most`` of a list's equal vectors in order of their ids."""
        mark = (raw.astype("float64") * np.random.default_rng(0).normal(size=raw.shape[1])).sum(axis=1)
        order = np.lexsort((did, mark, at))
        new = (np.diff(mark[order]) != 0) | (np.diff(at[order]) != 0)
        start = np.flatnonzero(np.r_[True, new][: len(order)])
        size = np.diff(np.r_[start, len(order)])
        place = np.arange(len(order)) - np.repeat(start, size)
        equal = (raw[order] == raw[np.repeat(order[start], size)]).all(axis=1)
        # different vectors with one mark are all kept
        if len(start):
            equal &= np.repeat(np.logical_and.reduceat(equal, start), size)
        needed = np.ones(len(raw), dtype=bool)
        needed[order[equal & (place >= most)]] = False
        return needed

    def _measured(self, unit: np.ndarray, qid: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of a query and a document the nearest ``k`` per query, ties in order of the ids, with their cosines."""
        if self.exclude_self:
            other = (qid[row] != self.did[col]) | ~self.known[col]
            row, col = row[other], col[other]
        score = np.empty(len(row))
        for at in range(0, len(row), MEASURED):
            part = slice(at, at + MEASURED)
            score[part] = (unit[row[part]] * self.unit[col[part]]).sum(axis=1)
        order = np.lexsort((self.did[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        near = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return row[near], col[near], score[near]

    def nearest(self, unit: np.ndarray, qid: np.ndarray, marks: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a few queries the nearest documents of the lists marked, none behind ``kth``."""
        rough, n = unit.astype("float32"), len(unit)
        best = np.repeat(kth.astype("float32")[:, None], self.k, axis=1)
        bar = best[:, 0] - self.slack
        same = np.flatnonzero(self.known & np.isin(self.did, qid)) if self.exclude_self else np.zeros(0, dtype="int64")
        found, held, width = [(np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"))], 0, max(1, PAIRS // max(n, 1))
        for i in range(len(self.bounds) - 1):
            row = np.flatnonzero(marks[:, i])
            if not len(row):
                continue
            own = rough[row]
            for at in range(self.bounds[i], self.bounds[i + 1], width):
                sims = own @ self.rough[at : min(at + width, self.bounds[i + 1])].T
                cols = same[slice(*np.searchsorted(same, (at, at + sims.shape[1])))]
                if len(cols):
                    sims[:, cols - at] = np.where(qid[row][:, None] == self.did[cols], -np.inf, sims[:, cols - at])
                if sims.shape[1] > self.k:
                    new = np.isneginf(bar[row])
                    if new.any():
                        bar[row[new]] = np.partition(sims[new], -self.k, axis=1)[:, -self.k] - self.slack
                hit = np.flatnonzero(sims.max(axis=1) >= bar[row])
                if not len(hit):
                    continue
                sims, hits = sims[hit], row[hit]
                r, c = np.nonzero(sims >= bar[hits][:, None])
                found.append((hits[r], at + c))
                # the bar rises with the best so far
                place = np.arange(len(r)) - np.searchsorted(r, r)
                more = np.full((len(hits), place.max() + 1), -np.inf, dtype="float32")
                more[r, place] = sims[r, c]
                more = np.concatenate([best[hits], more], axis=1)
                more.partition(more.shape[1] - self.k, axis=1)
                best[hits] = more[:, -self.k :]
                bar[hits] = np.maximum(bar[hits], best[hits].min(axis=1) - self.slack)
                held += len(r)
                if held > PAIRS:
                    found = [self._measured(unit, qid, *(np.concatenate(x) for x in zip(*found, strict=True)))[:2]]
                    held = len(found[0][0])
        return self._measured(unit, qid, *(np.concatenate(x) for x in zip(*found, strict=True)))


def _best(k: int, exclude_self: bool, ranges: list[tuple[int, int]]):
    """The k nearest documents of a block for each query of a part, all ties at the border in order of their ids."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            lo, hi = ranges[left["block"][0].as_py()]
            block = _Block(right, (lo, hi), k, exclude_self)
            for at in range(0, left.num_rows, QUERIES):
                q = left.slice(at, QUERIES)
                unit, qid = unit_rows(matrix(q["qv"])), q["qid"].to_numpy()
                packed = np.frombuffer(b"".join(q["marks"].to_pylist()), dtype="uint8").reshape(len(qid), -1)
                marks = np.unpackbits(packed, axis=1, count=hi - lo).astype(bool) & np.isfinite(unit).all(axis=1)[:, None]
                row, col, score = block.nearest(unit, qid, marks, q["kth"].to_numpy())
                out.append(pa.table([qid[row], right["did"].take(pa.array(block.rows[col])), score], ["query_id", "doc_id", "score"]))
        kinds = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
        return pa.concat_tables([kinds.empty_table(), *out])

    return run


def _probe(lists: Lists, probes: int, rest: bool):
    """Queries to one row per list they read: the first ``probes`` or, of the ``rest``, those that can hold something as near as ``kth``.

    A few queries at a time: each may read every list.
    """
    step = max(1, ASKED // len(lists.size))

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in chunks:
            for at in range(0, len(whole), step):
                chunk = whole.iloc[at : at + step]
                unit = unit_rows(chunk["qv"])
                marks = lists.nearest(unit, probes)
                if rest:
                    marks = ~marks & (lists.bounds(unit) >= chunk["kth"].to_numpy()[:, None])
                row, at = np.nonzero(marks)
                if len(row):
                    yield pd.DataFrame({"qid": chunk["qid"].to_numpy()[row], "list": at})

    return run


def _ask(lists: Lists, ranges: list[tuple[int, int]], probes: int, rest: bool, counts: bool):
    """Queries to one row per block that holds lists they read, with marks for those; with ``counts`` only their numbers."""
    step, probe = max(1, ASKED // len(lists.size)), _probe(lists, probes, rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                marks = np.zeros((batch.num_rows, len(lists.size)), dtype=bool)
                places = pd.DataFrame({"qid": np.arange(batch.num_rows), "qv": list(matrix(batch.column("qv"))), "kth": batch.column("kth").to_numpy()})
                for read in probe([places]):
                    marks[read["qid"], read["list"]] = True
                asked = [np.flatnonzero(marks[:, lo:hi].any(axis=1)) for lo, hi in ranges]
                if counts:
                    n = [len(rows) for rows in asked]
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64())], ["block", "n"])
                    continue
                for block, (lo, hi) in enumerate(ranges):
                    if len(asked[block]):
                        own = batch.take(pa.array(asked[block]))
                        bits = [row.tobytes() for row in np.packbits(marks[asked[block], lo:hi], axis=1)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([block] * len(bits), pa.int32()), *own.columns, pa.array(bits, pa.binary())], ["block", "qid", "qv", "kth", "marks"])

    return run


def search_lists(
    queries: DataFrame, listed: DataFrame, lists: Lists, probes: int, rest: bool, k: int, exclude_self: bool, query_block: int, doc_block: int,
) -> DataFrame:
    """The k nearest documents of the lists that queries (``qid, qv, kth``) read, per query and block of documents.

    A block holds neighbouring lists or a part of a long one, and its queries
    are cut into parts, so a task gets one block and one part, whatever share of
    either a list holds, and a query comes once to a block with all the lists it
    reads there.  A part has at least ``query_block`` queries, as far as there
    are, and more, up to ``PART_BLOCKS`` times as many, where the tasks suffice
    for the session's cores.
    """
    first, own, ranges = block_lists(lists.size, doc_block)
    probed = lambda counts, kind: queries.mapInArrow(_ask(lists, ranges, probes, rest, counts), kind)
    asked = {r["block"]: r["n"] for r in probed(True, "block int, n bigint").groupBy("block").agg(F.sum("n").alias("n")).collect()}
    tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism

    def number(n: int) -> int:
        return max(1, min(max(-(-n // (PART_BLOCKS * query_block)), -(-tasks // len(ranges))), -(-n // query_block)))

    def of(numbers, at: str) -> Column:
        return F.element_at(F.array(*[F.lit(int(n)) for n in numbers]), F.col(at).cast("int") + 1)

    n = [asked.get(i) or 0 for i in range(len(ranges))]
    parts = of(map(number, n), "block")
    d = listed.withColumn("block", (of(first, "list") + F.pmod(F.xxhash64("did"), of(own, "list"))).cast("int")).where(of(n, "block") > 0)
    d = d.select("block", "list", "did", "dv", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    q = probed(False, f"block int, qid bigint, qv {queries.schema['qv'].dataType.simpleString()}, kth double, marks binary")
    q = q.withColumn("part", F.pmod(F.xxhash64("qid"), parts).cast("int"))
    return q.groupBy("block", "part").cogroup(d.groupBy("block", "part")).applyInArrow(_best(k, exclude_self, ranges), FOUND)


def topk_passages(
    queries: DataFrame, docs: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", exclude_self: bool = True,
    query_block: int = 4096, doc_block: int = 65536, probes: int | None = None, n_lists: int | None = None, seed: int = 0,
) -> DataFrame:
    """Top-k documents per query by cosine: ``query_id, doc_id, score, rank``; ties by smaller id.

    Documents are grouped around ``n_lists`` centroids (the root of their number,
    at most ``MOST_LISTS``) and each query is compared with the documents of the
    lists it probes, none else.  With ``probes`` it reads that many lists, the
    nearest ones.  Without, the result is exact: after the first lists a query
    reads those in which, by the angle to the centroid and the list's widest
    angle, a document as near as its k-th so far could lie.

    The lists are trained and their sizes read when this is called.  Rows
    without a vector take no part.
    """
    docs, queries = docs.where(F.col(vector).isNotNull()), queries.where(F.col(vector).isNotNull())
    n = docs.count()
    if n == 0:
        return docs.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    n_lists = min(n, n_lists or min(MOST_LISTS, int(np.ceil(np.sqrt(n)))))
    listed, lists = list_documents(docs, train_centroids(docs, n, n_lists, vector, id_col, seed=seed), vector, id_col)
    qv, _ = _vectors(vector, queries)
    q = queries.select(F.col(id_col).cast("long").alias("qid"), qv.alias("qv")).where("qid IS NOT NULL")
    first = probes or max(1, int(np.sqrt(n_lists)))
    search = lambda asked, rest: search_lists(asked, listed, lists, first, rest, k, exclude_self, query_block, doc_block)
    ranked = lambda near: near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    near = ranked(search(q.withColumn("kth", F.lit(float("-inf"))), False))
    if probes:
        return near
    near = cut(near.drop("rank"))
    kth = near.groupBy(F.col("query_id").alias("qid")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(float("-inf")).alias("kth"))
    # a query that found nothing yet reads every list
    asked = q.join(kth, "qid", "left").select("qid", "qv", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    more = search(asked, True)
    return ranked(near.unionByName(more))


def recall_at_k(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true pairs (``query_id, doc_id``) that were found: one row ``queries, wanted, recall``."""
    hit = found.select("query_id", "doc_id", F.lit(1).alias("_hit"))
    d = truth.select("query_id", "doc_id").join(hit, ["query_id", "doc_id"], "left")
    return d.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
