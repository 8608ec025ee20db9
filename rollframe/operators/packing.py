"""Length balancing and packing, batch by batch.

Differencing and the greedy rule need all weights of a batch in order, so a
batch, which is one training batch, is placed inside a task that holds its
rows.  Serpentine dealing needs only distributed
ranks and suits batches of any size; callers choose by name.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import col
from ..functions.groups import attach_group_stats, number_rows, rank_by_value, row_total
from ..session import cut


def attention_workload(length: str | Column) -> Column:
    """Relative cost of a row of tokens: a linear and a quadratic part."""
    n = col(length).cast("long")
    return F.lit(24576).cast("long") * n + n * n


# ---------------------------------------------------------------- inside a task
def _ranked(parts: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, list[int]]]:
    """(sum, place, rows) of the parts that hold rows, in falling order of sum among k parts.

    Empty parts are not stored; a stable order puts them between rows of sum 0
    by their places.
    """
    full = [p for p in parts if p[0]]
    zero = [p for p in parts if not p[0]]
    by_place = sorted(p[1] for p in full)
    out = [(s, i, rows) for i, (s, _, rows) in enumerate(sorted(full, key=lambda p: (-p[0], p[1])))]
    for _, place, rows in zero:
        out.append((0, len(full) + place - bisect_left(by_place, place), rows))
    return out


def differencing(weights: Sequence[int], k: int, equal_size: bool) -> list[int]:
    """Part number of every weight: largest-first differencing into k parts.

    A partial solution is k parts in falling order of their sums; the two with
    the widest spread are joined heaviest to lightest until one is left.  Only
    parts with rows are kept, so memory follows the rows, not rows times k.
    """
    n = len(weights)
    if n < k:
        raise ValueError(f"{n} rows cannot fill {k} parts")
    if equal_size and n % k:
        raise ValueError(f"{n} rows are not divisible into {k} equal parts")
    by_weight = sorted(range(n), key=lambda i: (weights[i], i))
    width = k if equal_size else 1

    def spread(parts):
        # a solution with empty parts has 0 as its least sum
        least = min(p[0] for p in parts) if len(parts) == k else 0
        return least - max(p[0] for p in parts)

    queue = []
    for at in range(0, n, width):
        rows = by_weight[at : at + width]
        parts = [(weights[i], place, [i]) for place, i in enumerate(reversed(rows))]
        parts = _ranked(parts) if len(rows) < k else parts
        queue.append((spread(parts), at, parts))
    heapq.heapify(queue)
    while len(queue) > 1:
        _, tie, left = heapq.heappop(queue)
        _, _, right = heapq.heappop(queue)
        joined = {place: (total, place, rows) for total, place, rows in left}
        for total, place, rows in right:
            place = k - 1 - place
            have = joined.get(place, (0, place, []))
            joined[place] = (have[0] + total, place, have[2] + rows)
        parts = _ranked(list(joined.values()))
        heapq.heappush(queue, (spread(parts), tie, parts))
    out = [0] * n
    last = queue[0][2]
    if len(last) < k:
        raise ValueError("a part is empty")
    for _, number, rows in last:
        for i in rows:
            out[i] = number
    return out


def greedy(weights: Sequence[int], k: int, equal_size: bool) -> list[int]:
    """Part number of every weight in row order: always the lightest part, the first on ties."""
    if equal_size and len(weights) % k:
        raise ValueError(f"{len(weights)} rows are not divisible into {k} equal parts")
    extra = sum(weights) + 1 if equal_size else 0
    load = [(0, part) for part in range(k)]
    out = []
    for w in weights:
        total, part = load[0]
        heapq.heapreplace(load, (total + w + extra, part))
        out.append(part)
    return out


def _per_batch(df: DataFrame, batch: str, order: str, weight: str | Column, assign: Callable[[list[int]], list[int]], out: str = "part") -> DataFrame:
    """``df`` and ``out``: ``assign`` maps the weights of one batch, in row order, to numbers.

    Spark brings each batch together and sorts it; a task then walks its rows,
    holds those of one batch at a time and hands them on with their numbers, so
    that nothing is joined back.  The rows are numbered by a window, which the
    adaptive planner must give whole batches; a repartition in front of a Python
    step binds it to nothing, and batches were torn apart behind a join.
    """
    d = df.withColumn("_weight", col(weight).cast("long"))
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.LongType())])

    def walk(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[pa.RecordBatch] = []
        name = None

        def close() -> Iterator[pa.RecordBatch]:
            parts = assign([w for rows in open_rows for w in rows.column("_weight").to_pylist()])
            at = 0
            for rows in open_rows:
                columns = [rows.column(f.name) for f in schema.fields[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(parts[at : at + len(rows)], type=pa.int64())], names=schema.names)
                at += len(rows)

        for chunk in chunks:
            names = chunk.column(batch).to_pylist()
            lo = 0
            while lo < len(names):
                hi = lo + 1
                while hi < len(names) and names[hi] == names[lo]:
                    hi += 1
                if open_rows and name != names[lo]:
                    yield from close()
                    open_rows = []
                name = names[lo]
                open_rows.append(chunk.slice(lo, hi - lo))
                lo = hi
        if open_rows:
            yield from close()

    # the walk finds its batches by their names; the number only has to be there
    return d.withColumn("_at", F.row_number().over(W.partitionBy(batch).orderBy(order))).mapInArrow(walk, schema)


def merge_solutions(blocks: Sequence[Sequence[int]]) -> list[list[int]]:
    """For solutions of k sums each, the part that every one of their parts goes to: heaviest onto lightest, the widest spread first.

    Where a falling and a rising row of sums are added, the spread is at most
    that of the wider one, so the merged spread is no wider than any block's.
    """
    k = len(blocks[0])
    total = [0] * k
    out: list[list[int]] = [[] for _ in blocks]
    for b in sorted(range(len(blocks)), key=lambda b: (min(blocks[b]) - max(blocks[b]), b)):
        heavy = sorted(range(k), key=lambda i: (-total[i], i))
        light = sorted(range(k), key=lambda i: (blocks[b][i], i))
        out[b] = [0] * k
        for to, part in zip(heavy, light):
            out[b][part] = to
            total[to] += blocks[b][part]
    return out


def _in_blocks(df: DataFrame, k: int, weight: str, batch: str, order: str, equal_size: bool, block_rows: int) -> DataFrame:
    """Differencing block by block; the blocks' sums, k numbers each, are merged per batch and tell the parts."""
    if equal_size and block_rows % k:
        raise ValueError(f"blocks of {block_rows} rows are not divisible into {k} equal parts")

    def assign(weights: list[int]) -> list[int]:
        if len(weights) >= k:
            return differencing(weights, k, equal_size)
        if equal_size:
            raise ValueError(f"{len(weights)} rows are left over for {k} equal parts")
        return list(range(len(weights)))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["_n"].sum() < k:
            raise ValueError(f"{rows['_n'].sum()} rows cannot fill {k} parts")
        sums = rows.pivot(index="_no", columns="_local", values="_s").reindex(columns=range(k)).fillna(0).astype("int64")
        maps = merge_solutions(sums.to_numpy().tolist())
        at = {no: i for i, no in enumerate(sums.index)}
        return rows[[batch, "_no", "_local"]].assign(part=[maps[at[no]][local] for no, local in zip(rows["_no"], rows["_local"])])

    kind = df.schema[batch].dataType.simpleString()
    d = number_rows(df.drop("part"), order, "_no", [batch]).withColumn("_no", F.expr(f"(_no - 1) div {int(block_rows)}"))
    placed = cut(_per_batch(d.withColumn("_block", F.struct(batch, "_no")), "_block", order, weight, assign, "_local").drop("_block"))
    sums = placed.groupBy(batch, "_no", "_local").agg(F.sum(col(weight).cast("long")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    parts = sums.groupBy(batch).applyInPandas(merge, f"{batch} {kind}, _no bigint, _local bigint, part bigint")
    return placed.join(parts, [batch, "_no", "_local"]).drop("_no", "_local")


# ---------------------------------------------------------------- operators
def serpentine_partitions(df: DataFrame, k: int, weight: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``part``: rows by falling weight, dealt forth and back over k parts."""
    d = rank_by_value(df, weight, order, "_r", keys, descending=True)
    at, lap = (F.col("_r") - 1) % k, F.floor((F.col("_r") - 1) / k)
    return d.withColumn("part", F.when(lap % 2 == 0, at).otherwise(k - 1 - at).cast("long")).drop("_r")


def balance_partitions(
    df: DataFrame, k: int, weight: str, batch: str = "batch_id", order: str = "traj_id", equal_size: bool = True, method: str = "differencing",
    block_rows: int = 65_536,
) -> DataFrame:
    """Adds ``part``: k parts per batch with near-equal sums of ``weight``.

    ``method`` is ``differencing``, a batch per task; ``blocks``, for batches
    beyond a task: differencing of ``block_rows`` rows at a time, whose solutions
    are merged by their sums, so that the parts differ by no more than the
    heaviest row; or ``serpentine``, by ranks alone.  Either way too few rows, or
    with ``equal_size`` a number of rows that k doesn't divide, is an error.
    """
    if method == "blocks":
        return _in_blocks(df, k, weight, batch, order, equal_size, block_rows)
    if method == "differencing":
        return _per_batch(df, batch, order, weight, lambda w: differencing(w, k, equal_size))
    if method == "serpentine":
        slim = df.select(batch, order, weight)
        dealt = attach_group_stats(serpentine_partitions(slim, k, weight, order, [batch]), [batch], [F.count(F.lit(1)).alias("_rows")])
        bad = (F.col("_rows") < k) | (F.lit(equal_size) & (F.col("_rows") % k != 0))
        fail = F.raise_error(F.concat(F.col("_rows").cast("string"), F.lit(f" rows do not make {k} parts"))).cast("long")
        parts = dealt.select(batch, order, F.when(bad, fail).otherwise(F.col("part")).alias("part"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.join(parts, [batch, order])


def greedy_partitions(
    df: DataFrame, k: int, weight: str, batch: str = "batch_id", order: str = "traj_id", equal_size: bool = False
) -> DataFrame:
    """Adds ``part``: every row, in order, to the lightest part so far."""
    return _per_batch(df, batch, order, weight, lambda w: greedy(w, k, equal_size))


def group_balance(df: DataFrame, k: int, length: str, batch: str = "batch_id", order: str = "traj_id", uid: str = "uid") -> DataFrame:
    """Adds ``part``: the same with all rows of a uid together and equally many uids per part."""
    groups = df.groupBy(batch, uid).agg(F.sum(attention_workload(length)).alias("_w"), F.min(order).alias("_first"))
    named = _per_batch(groups, batch, "_first", "_w", lambda w: differencing(w, k, True))
    return df.join(named.select(batch, uid, "part"), [batch, uid])


def pack_microbatches(
    df: DataFrame, max_tokens: int, length: str, batch: str = "batch_id", order: str = "traj_id", multiple: int = 1, minimum: int | None = None
) -> DataFrame:
    """Adds ``micro_id`` (place in the run order) per batch.

    A batch gets ceil(tokens / max_tokens) micro-batches, at most one per row,
    raised to ``minimum`` and to a multiple; rows are balanced by workload; the
    heavy micro-batches run in the middle.
    """
    def place(lens: list[int]) -> list[int]:
        if max(lens) > max_tokens:
            raise ValueError(f"a row of {max(lens)} tokens exceeds {max_tokens}")
        count = max(min(len(lens), -(-sum(lens) // max_tokens)), minimum or 1, 1)
        count = -(-count // multiple) * multiple
        work = [24576 * n + n * n for n in lens]
        part = differencing(work, count, False)
        load, first = [0] * count, [len(part)] * count
        for i, p in enumerate(part):
            load[p] += work[i]
            first[p] = min(first[p], i)
        heavy_first = sorted(range(count), key=lambda p: (load[p], first[p]), reverse=True)
        at = {p: i for i, p in enumerate(heavy_first[::2][::-1] + heavy_first[1::2])}
        return [at[p] for p in part]

    return _per_batch(df, batch, order, length, place, "micro_id")


def restore_order(packed: DataFrame, order: str = "traj_id") -> DataFrame:
    """Packed rows back in their own order, as ``pos``; the packing columns go."""
    d = number_rows(packed, order, "pos").withColumn("pos", F.col("pos") - 1)
    return d.drop("micro_id", "part")


def run_order(df: DataFrame, weight: str, batch: str = "batch_id", order: str = "traj_id") -> DataFrame:
    """Adds ``slot`` inside each part: light rows at both ends, heavy ones in the middle.

    A part is what one worker takes of a batch, so a window holds it.
    """
    part = W.partitionBy(batch, "part")
    r = F.row_number().over(part.orderBy(weight, order)) - 1
    half = F.floor(r / 2)
    n = F.count(F.lit(1)).over(part)
    return df.withColumn("slot", F.when(r % 2 == 0, half).otherwise(n - 1 - half).cast("long"))


def balance_batch(
    df: DataFrame, k: int, length: str, batch: str = "batch_id", order: str = "traj_id",
    by_uid: bool = False, minibatch: str | None = None,
) -> DataFrame:
    """Adds ``part`` (worker) and ``slot`` (place on it).

    Balanced over the batch, per minibatch (``minibatch`` names its column) or
    with uids kept whole; in the last case rows of a part stay in row order.
    """
    if by_uid:
        d = group_balance(df, k, length, batch, order)
        slot = F.row_number().over(W.partitionBy(batch, "part").orderBy(order)) - 1
        return d.withColumn("slot", slot.cast("long"))
    d = df.withColumn("_w", attention_workload(length))
    if minibatch:
        d = d.withColumn("_mb", F.concat_ws("/", F.col(batch).cast("string"), F.col(minibatch).cast("string")))
        d = balance_partitions(d, k, "_w", "_mb", order).drop("_mb")
    else:
        d = balance_partitions(d, k, "_w", batch, order)
    return run_order(d, "_w", batch, order).drop("_w")


def balance_report(df: DataFrame, k: int, weight: str, order: str = "traj_id", part: str = "part") -> DataFrame:
    """Spread of sums over contiguous chunks of n // k rows against the balanced parts; one row.

    A remainder makes one more, shorter chunk.
    """
    n = row_total(df)
    d = number_rows(df, order, "_rn").withColumn("_chunk", F.floor((F.col("_rn") - 1) / F.floor(n / F.lit(k))))
    plain = d.groupBy("_chunk").agg(F.sum(weight).alias("s"))
    plain = plain.agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.sum("s") / k).alias("mean"))
    even = df.groupBy(part).agg(F.sum(weight).alias("s")).agg(
        F.struct(F.min("s").alias("lo"), F.max("s").alias("hi"))
    ).scalar()
    return plain.withColumn("_e", even).select(
        "min", "max", (F.col("max") - F.col("min")).alias("minmax_diff"),
        F.col("_e.lo").alias("balanced_min"), F.col("_e.hi").alias("balanced_max"), "mean",
    )
