"""Mixing sources to target weights by weighted sampling without replacement (exponential keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.groups import with_slot
from ..session import cut
from .common import row_key, uniform, word_count

SLOTS = 256


def text_quality(text: str = "text") -> Column:
    """Share of letters and white space in a text, from 0.1 to 1.1; 0.1 for null and empty."""
    kept = F.length(F.regexp_replace(F.col(text), r"[^\p{L}\x20\x09-\x0D]+", ""))
    return F.coalesce(F.try_divide(kept, F.length(text)), F.lit(0.0)) + F.lit(0.1)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, with ``target``.

    Sources in code point order, null last, take the weights in turn and share
    the total size by them.  A target stops at ``most`` times its source's
    size; the excess goes to the others by weight until none is above: sources
    in rising order of limit per weight fill up one after another.
    """
    turn = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = (F.row_number().over(turn) - 1) % len(weights)
    rows = sizes.withColumn("_w", F.element_at(cycle, place + 1))
    rows = rows.withColumn("_limit", F.lit(float(most)) * F.col("source_size"))
    rising = W.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    earlier = rising.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(earlier), F.lit(0.0))
    open_weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))
    # once a source stays below its limit, so do all later ones, at that level
    rows = rows.withColumn("_level", left / open_weight)
    rows = rows.withColumn("_level", F.when(F.col("_level") * F.col("_w") <= F.col("_limit"), F.col("_level")))
    so_far = rising.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_level", F.first("_level", ignorenulls=True).over(so_far))
    target = F.when(F.col("_level").isNull(), F.col("_limit")).otherwise(F.least("_limit", F.col("_level") * F.col("_w")))
    return rows.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    most: float = 3.0,
    seed: int = 0,
    quality: Column | None = None,
    slots: int = SLOTS,
) -> DataFrame:
    """How often, and how far, each document of ``docs`` (doc_id, text, source) enters the mix.

    Each source is taken whole as often as its target allows; the rest of the
    target is filled in the order of -ln(u) / quality, u a hash of doc_id
    (smaller keys first), up to the word budget; the document on the border is
    taken in part.  Sums along the key run inside ``slots`` ranges of the key
    per source and add a carry.  The ranges are quantiles of all rows' keys, so
    they are even for any quality, and documents with one key are told apart by
    their texts: a source of any size spreads over tasks.

    Columns: doc_id, source, size (words), source_size, target, epochs (whole
    rounds), before (words ahead of the document in the last round), budget
    (words of the last round), extra (words it takes then), taken, row_key.
    A null text has no words, a null source is a source of its own, a null
    doc_id is an id of its own.  Repeated rows count each, in any order.  An
    empty table gives no rows.
    """
    quality = text_quality() if quality is None else quality
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        (-F.ln(uniform("doc_id", seed=seed)) / quality).alias("_key"),
        row_key("doc_id", "text").alias("row_key"),
    )
    rows = with_slot(cut(rows.withColumn("_order", F.struct("_key", "row_key"))), "_order", "_slot", slots).drop("_order")
    totals = rows.groupBy("source", "_slot").agg(F.sum("size").alias("_sum"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, most)
    ahead = W.partitionBy("source").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select("source", "_slot", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_carry"))
    carry = carry.join(targets, carry["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    carry = carry.select(F.col("source").alias("_s"), F.col("_slot").alias("_t"), "_carry", "source_size", "target")
    inside = W.partitionBy("source", "_slot").orderBy("_key", "doc_id", "row_key").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("_upto", F.sum("size").over(inside))
    out = out.join(carry, out["source"].eqNullSafe(carry["_s"]) & (out["_slot"] == carry["_t"]))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = out.withColumn("epochs", F.floor(ratio).cast("long"))
    out = out.withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    out = out.withColumn("before", F.col("_carry") + F.col("_upto") - F.col("size"))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before")))
    out = out.withColumn("extra", extra.cast("long"))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "before", "budget", "extra",
        (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"), "row_key",
    )


def whole_copies() -> Column:
    """How often a document enters the mix if it can't be cut: the one on the border stays if half of it fits."""
    last = (F.col("before") < F.col("budget")) & (2 * F.col("extra") >= F.col("size"))
    return F.col("epochs") + last.cast("long")


def repeat_to_mix(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text and others), each as often as ``copies`` (row_key, n) says.

    Repeated rows are told apart by their number within the key.
    """
    alike = W.partitionBy("_k").orderBy(F.lit(0))
    numbered = docs.withColumn("_k", row_key("doc_id", "text")).withColumn("_i", F.row_number().over(alike))
    many = copies.select(F.col("row_key").alias("_k"), "n").where("n > 0")
    many = many.withColumn("_i", F.row_number().over(W.partitionBy("_k").orderBy(F.desc("n"))))
    out = numbered.join(many, ["_k", "_i"]).withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select(*docs.columns)
