"""Hard-negative mining by the threshold algorithm over per-dimension sorted lists of integer vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

BLOCK_ROWS = 8192
PART_ROWS = 1024
#: Sorted accesses per list before the threshold is looked at; the last look is at the end of the lists.
DEPTHS = (1, 8, 64, 512)
#: Sums of products below this are exact in double precision.
EXACT = 1 << 53
#: Scores stay below this, so that their multiples in the windows fit in 64 bits.
LARGEST = 1 << 56


class Lists:
    """A block of vectors and, for every dimension, its rows from the largest component to the smallest."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.order = np.argsort(-vectors.T, axis=1, kind="stable") if order is None else order

    def __len__(self) -> int:
        return len(self.ids)

    def thresholds(self, anchors: np.ndarray, depth: int) -> np.ndarray:
        """The most that a row can score that none of the first ``depth`` entries of an anchor's lists names.

        An anchor reads the list of a dimension from the top if its own
        component is positive and from the bottom if it is negative.
        """
        at = np.arange(self.vectors.shape[1])
        top = self.vectors[self.order[:, depth - 1], at]
        bottom = self.vectors[self.order[:, len(self) - depth], at]
        return np.maximum(anchors, 0) @ top + np.minimum(anchors, 0) @ bottom

    def heads(self, anchor: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Rows named by the entries ``begin`` to ``end`` of the anchor's lists, again and again if need be."""
        up, down = self.order[anchor > 0, begin:end], self.order[anchor < 0, len(self) - end : len(self) - begin]
        return np.concatenate([up.ravel(), down.ravel()])


def first_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id, in that order."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[-k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Search:
    """What an anchor has found in a block: for each of its windows of scores the first ``k`` of the rows it may take."""

    def __init__(self, windows: list[tuple[int, int]], k: int) -> None:
        self.k, self.windows = k, [w for w in windows if w[0] <= w[1]]
        self.rows, self.scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def over(self, threshold: int) -> bool:
        """Whether no row scoring ``threshold`` or less could still be among the first: strictly below each window's kth, or below the window."""
        for low, high in self.windows:
            if threshold < low:
                continue
            inside = self.scores[(self.scores >= low) & (self.scores <= high)]
            if len(inside) < self.k or threshold >= np.partition(inside, len(inside) - self.k)[-self.k]:
                return False
        return True

    def see(self, rows: np.ndarray, scores: np.ndarray) -> None:
        """Scored rows that the anchor may take; those below all windows are forgotten."""
        if self.windows:
            keep = (scores >= min(w[0] for w in self.windows)) & (scores <= max(w[1] for w in self.windows))
            self.rows, self.scores = np.r_[self.rows, rows[keep]], np.r_[self.scores, scores[keep]]

    def first(self, window: tuple[int, int], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.flatnonzero((self.scores >= window[0]) & (self.scores <= window[1]))
        best = inside[first_rows(self.scores[inside], ids[self.rows[inside]], self.k)]
        return self.rows[best], self.scores[best]


def threshold_search(block: Lists, anchors: np.ndarray, windows: list[list[tuple[int, int]]], allowed, k: int) -> tuple[list[Search], int]:
    """The threshold algorithm for every anchor (a row of integers) in one block, and how many rows were scored.

    All anchors read their lists in step.  At each depth an anchor whose
    threshold is strictly below what its windows still need is done; the rows
    newly named by the others' lists are scored by random access.
    ``allowed(anchor number, rows)`` tells which rows it may take.
    """
    found, accesses = [Search(w, k) for w in windows], 0
    seen = np.zeros((len(anchors), len(block)), dtype=bool)
    depths = [d for d in DEPTHS if d * anchors.shape[1] < len(block)] + [len(block)] if len(block) else []
    waiting, before = list(range(len(anchors))), 0
    for depth in depths:
        still = []
        for a in waiting:
            anchor = anchors[a]
            if depth < len(block):
                named = np.unique(block.heads(anchor, before, depth))
                named = named[~seen[a, named]]
            else:  # the ends of the lists: whatever no list has named so far
                named = np.flatnonzero(~seen[a])
            seen[a, named] = True
            accesses += len(named)
            rows = named[allowed(a, named)]
            found[a].see(rows, block.vectors[rows] @ anchor)
            still.append(a)
        limit = block.thresholds(anchors[still], depth) if depth < len(block) else None
        waiting = [a for i, a in enumerate(still) if limit is not None and not found[a].over(limit[i])]
        before = depth
    return found, accesses


def _pack(block_type: str):
    """The rows of a block as bytes, with the order of each dimension's list."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("label", "ascending"), ("vec_id", "ascending")])
        ids, labels = (table.column(c).to_numpy().astype("<i8") for c in ("vec_id", "label"))
        vectors = table.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = Lists(ids, labels, vectors).order
        payload = [x.tobytes() for x in (ids, labels, vectors.astype(block_type), order.astype("<u2"))]
        return pa.table({"block": table.column("block")[:1], **{n: pa.array([p], type=pa.binary()) for n, p in zip(("ids", "labels", "vectors", "lists"), payload)}})

    return run


def _meet(block_type: str, size: int, exact: bool, k: int, low: int, high: int, whole: int, same: bool):
    """The first rows of a block for the anchors of a part: of their own label, or in the windows of their positives."""
    kind = np.float64 if exact else np.int64

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {n: [] for n in ("anchor_id", "positive_id", "positive_score", "vec_id", "score")}
        if left.num_rows and right.num_rows:
            raw = {n: left.column(n)[0].as_py() for n in ("ids", "labels", "vectors", "lists")}
            ids, labels = np.frombuffer(raw["ids"], dtype="<i8"), np.frombuffer(raw["labels"], dtype="<i8")
            vectors = np.frombuffer(raw["vectors"], dtype=block_type).reshape(-1, size).astype(kind)
            block = Lists(ids, labels, vectors, np.frombuffer(raw["lists"], dtype="<u2").reshape(size, -1).astype(np.int64))
            right = right.combine_chunks()
            own, label = right.column("vec_id").to_numpy(), right.column("label").to_numpy()
            anchors = right.column("codes").combine_chunks().flatten().to_numpy().reshape(-1, size).astype(kind)
            if same:
                given = [[(None, None)]] * len(own)
                windows = [[(-LARGEST, LARGEST)]] * len(own)
                allowed = lambda a, rows: (labels[rows] == label[a]) & (ids[rows] != own[a])
            else:
                given = [[(p["vec_id"], p["score"]) for p in ps] for ps in right.column("positives").to_pylist()]
                windows = [[(-(-low * s // whole), high * s // whole) for _, s in ps] for ps in given]
                allowed = lambda a, rows: labels[rows] != label[a]
            for at in range(0, len(own), 256):
                part = slice(at, at + 256)
                found, _ = threshold_search(block, anchors[part], windows[part], lambda a, rows: allowed(at + a, rows), k)  # noqa: B023
                for a, search in enumerate(found, at):
                    for (positive, positive_score), window in zip(given[a], windows[a]):
                        for row, score in zip(*search.first(window, ids)):
                            for name, value in zip(out, (own[a], positive, positive_score, ids[row], int(score))):
                                out[name].append(value)
        return pa.table({n: pa.array(v, type=pa.int64()) for n, v in out.items()})

    return run


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, whole: int = 100, scale: int = 256,
    block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS,
) -> DataFrame:
    """For the rows of ``vectors`` (vec_id, label, embedding) where ``anchor`` holds: rows of other labels that score close to their positives.

    A component x counts as floor(scale * x) and a pair scores its integer
    inner product.  The positives of an anchor are its ``positives`` first other
    rows of the same label; for each of them, the ``negatives`` first rows of
    other labels with low * positive <= whole * score <= high * positive are
    returned.  Higher scores come first, ties by smaller vec_id.

    Rows are dealt by hash to blocks of about ``block_rows``; a block keeps its
    rows in order of every dimension.  Every block meets every part of
    ``part_rows`` anchors once, for the positives and again for the negatives,
    and runs the threshold algorithm: each anchor reads all lists in step, from
    the end that its own component's sign favours, scores the rows it meets,
    and stops once no unread row could enter any of its windows.  The first
    rows of the blocks are ranked in the end, so results are exact.  A task
    holds one block and one part.

    Columns: anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score.  Null ids, labels or vectors, and vectors
    with a null or non-finite component take no part, nor do vectors whose
    length isn't the most frequent one (the larger, if two are).  A repeated id
    counts once, with its smallest label and vector, and is an anchor if one of
    its rows is.  Components too large for 64-bit scores are an error.  Empty
    tables give no rows.
    """
    if block_rows > 1 << 14:
        raise ValueError("a block's rows are numbered in 16 bits")
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite)
    most = F.max(F.array_max(F.transform("embedding", F.abs))).alias("most")
    common = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"), most, F.count_if("is_anchor").alias("anchors"))
    common = common.orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    size, bound = common["size"], float(scale) * common["most"] + 1
    if bound * bound * size >= LARGEST:
        raise ValueError(f"components up to {common['most']} are too large for 64-bit scores")
    block_type = next(t for t, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if bound < 1 << bits)
    exact = bound * bound * size < EXACT
    codes = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    rows = rows.where(F.size("embedding") == size).select("vec_id", F.struct("label", codes.alias("codes")).alias("row"), "is_anchor")
    rows = rows.groupBy("vec_id").agg(F.min("row").alias("row"), F.max("is_anchor").alias("is_anchor")).select("vec_id", "row.label", "row.codes", "is_anchor")
    blocks, parts = -(-common["n"] // block_rows), max(1, -(-common["anchors"] // part_rows))
    dealt = cut(rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))))
    packed = dealt.drop("is_anchor").groupBy("block").applyInArrow(_pack(block_type), "block long, ids binary, labels binary, vectors binary, lists binary")
    packed = cut(packed)
    asked = dealt.where("is_anchor").select("vec_id", "label", "codes", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(parts)).alias("part"))
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks * parts, 1 << 16))

    def meetings(anchors: DataFrame, k: int, same: bool) -> DataFrame:
        left = packed.withColumn("part", number(parts)).repartition(tasks, "block", "part")
        right = anchors.withColumn("block", number(blocks)).repartition(tasks, "block", "part")
        meet = _meet(block_type, size, exact, k, low, high, whole, same)
        both = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
        return both.applyInArrow(meet, "anchor_id long, positive_id long, positive_score long, vec_id long, score long")

    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    near = meetings(asked, positives, True).withColumn("rank", rank("anchor_id")).where(F.col("rank") <= positives)
    own = near.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    asked = cut(asked.join(own.withColumnRenamed("anchor_id", "vec_id"), "vec_id"))
    found = meetings(asked, negatives, False).withColumn("rank", rank("anchor_id", "positive_id")).where(F.col("rank") <= negatives)
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
