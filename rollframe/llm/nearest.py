"""Approximate nearest neighbours over randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_BLOCK = 2048
BROADCAST_BYTES = 64 << 20


def rotation(size: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere for one seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


class Codes:
    """One bit per rotated coordinate of unit vectors from a centre, packed, and two scalars per vector."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray) -> None:
        self.turn, self.size = turn, vectors.shape[1]
        self.centre = vectors.mean(0)
        away = vectors - self.centre
        self.norm = np.sqrt((away * away).sum(1))
        unit = away / np.where(self.norm > 0, self.norm, 1)[:, None] @ turn
        self.bits = np.packbits(unit > 0, axis=1)
        # inner product of the unit vector and its code; a vector on the centre has none
        self.fit = np.where(self.norm > 0, np.abs(unit).sum(1) / np.sqrt(self.size), 1.0)

    def bounds(self, queries: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances (queries x vectors) and what they should not fall below.

        The code's inner product with the query over ``fit`` is an unbiased
        estimate of the true one, and strays with the part of the vector that
        the code misses: ``width`` standard deviations make the bound.
        """
        away = queries - self.centre
        far = np.sqrt((away * away).sum(1))
        unit = away / np.where(far > 0, far, 1)[:, None] @ self.turn
        signs = np.unpackbits(self.bits, axis=1, count=self.size).astype(np.float32) * 2 - 1
        inner = (unit.astype(np.float32) @ signs.T) / np.sqrt(self.size) / self.fit
        stray = width * np.sqrt(np.maximum(0, 1 - self.fit**2)) / self.fit / np.sqrt(max(1, self.size - 1))
        square = far[:, None] ** 2 + self.norm**2
        scale = 2 * far[:, None] * self.norm
        return square - scale * inner, square - scale * (inner + stray) - 1e-6


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed in the order of the coordinates."""
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        step = vectors[:, j] - query[j]
        total += step * step
    return np.sqrt(total)


def _pack(size: int):
    """Batches of vectors to one row each: ids and coordinates as bytes, each id once."""

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, size)
            _, first = np.unique(ids, return_index=True)
            if len(first):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[first].astype("<i8").tobytes()], type=pa.binary()), pa.array([flat[first].tobytes()], type=pa.binary())],
                    names=["ids", "vectors"],
                )

    return run


def _search(size: int, k: int, width: float, seed: int):
    def run(batches):
        turn = rotation(size, seed)
        found: dict[tuple, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], dtype="<i8")
                vectors = np.frombuffer(row["vectors"], dtype="<f8").reshape(-1, size)
                codes = Codes(vectors, turn)
                queries = np.array([q["embedding"] for q in row["queries"]], dtype=float)
                for a in range(0, len(queries), 256):
                    guess, least = codes.bounds(queries[a : a + 256], width)
                    for i, q in enumerate(row["queries"][a : a + 256]):
                        own = ids != q["vec_id"]
                        best = found.get(q["vec_id"], [])
                        # exact distances of the likeliest few give the limit for all others
                        few = np.flatnonzero(own)
                        few = few[np.argsort(guess[i][few], kind="stable")[:k]]
                        near = np.sort(np.r_[distances(queries[a + i], vectors[few]), [d for d, _ in best]])
                        limit = near[k - 1] if len(near) >= k else np.inf
                        pick = np.flatnonzero(own & (least[i] <= limit * limit))
                        pairs = zip(distances(queries[a + i], vectors[pick]).tolist(), ids[pick].tolist())
                        merged: dict[int, float] = {}
                        for d, v in sorted([*best, *pairs]):
                            if v not in merged and len(merged) < k:
                                merged[v] = d
                        found[q["vec_id"]] = [(d, v) for v, d in merged.items()]
        rows = [(q, v, d) for q, best in found.items() for d, v in best]
        for at in range(0, len(rows), 10_000):
            q, v, d = zip(*rows[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(q, type=pa.int64()), pa.array(v, type=pa.int64()), pa.array(d, type=pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def usable(embedding: Column) -> Column:
    """Vectors that take part: not null, not zero, all components finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 10, width: float = 4.0, seed: int = 0) -> DataFrame:
    """The ``k`` nearest of ``candidates`` (vec_id, embedding) to each of ``queries`` (the same columns).

    Each batch of candidates becomes a block with codes around its own centre.
    Every block meets every block of queries once, by an equi-join on the
    number of the query block; within a meeting the codes' bounds choose the
    vectors whose exact distances are taken.  A task keeps k rows per query of
    its blocks, and a last rank merges them.  Query blocks are broadcast while
    all of them are within ``BROADCAST_BYTES`` and shuffled beyond that.

    Columns: query_id, rank (from 1), vec_id, score (Euclidean distance, double
    precision); ties go to the smaller vec_id; a row is no candidate of its own
    id.  Null, zero and non-finite vectors take no part, nor do null ids, nor
    vectors whose length isn't the most frequent one (the larger, if two are).
    A repeated id counts once per list, at its nearest; as a query, with its
    smallest vector.  Empty tables give no rows.
    """
    pick = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    rows = candidates.select(*pick).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    asked = queries.select(*pick).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    schema = "query_id long, rank int, vec_id long, score double"
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return candidates.sparkSession.createDataFrame([], schema)
    size = common["n"]
    rows, asked = rows.where(F.size("embedding") == size), asked.where(F.size("embedding") == size)
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    total = asked.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    packed = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    packed = packed.agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("queries"))
    if total * size * 8 <= BROADCAST_BYTES:
        packed = F.broadcast(packed)
    parts = rows.mapInArrow(_pack(size), "ids binary, vectors binary")
    meet = parts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(packed, "block")
    found = meet.mapInArrow(_search(size, k, width, seed), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
