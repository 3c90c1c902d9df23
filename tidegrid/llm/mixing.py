"""Mixing sources to target weights with hash-threshold histograms.

A document's place in the mix is a hash of its id, so a budget is a threshold
on that hash. Tokens are summed by source and hash bucket; the bucket in which
the budget runs out is found from the running sum over at most 1,024 buckets a
source and refined, by ten more bits of the hash each time, until it is one
hash value. Sums are formed before anything is shuffled, so a level moves at
most 1,024 rows a source and task, however many documents a source has. Budgets
nest: the documents of a smaller budget are among those of a larger one. No
document is sorted, and only the boundary bucket is looked at again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Hash bits in all, and by refinement.
BITS, STEP = 60, 10
#: Sources up to which the small per-source table is broadcast (under 10 MB).
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of ASCII-blank-parted text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(id_col: Column) -> Column:
    """60 hash bits of the id as text: the first 15 hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float, budget: float) -> DataFrame:
    """Targets of the sources (``_s`` null last, ``_size``): shares by weight, none above ``cap`` sizes.

    What a capped source can't take is shared again by weight. Capped sources
    are a prefix in the order of cap / weight, so the final level is found with
    running sums instead of rounds. One row a source is windowed, not documents.
    """
    everything = Window.orderBy(F.col("_s").isNull(), F.col("_s"))
    number = (F.row_number().over(everything) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), number.cast("int") + 1)
    t = sizes.withColumn("_w", w).withColumn("_cap", F.lit(float(cap)) * F.col("_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_s").isNull(), F.col("_s"))
    upto, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    t = t.withColumn("_total", F.sum("_size").over(whole) * F.lit(float(budget)))
    t = t.withColumn("_before", F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))).withColumn("_left", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0)))
    # The level if this source and all after it in the order are not capped.
    t = t.withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_left"))
    free = F.col("_level") * F.col("_w") <= F.col("_cap")
    t = t.withColumn("_n", F.row_number().over(order)).withColumn("_free", free)
    level = F.min_by("_level", F.when(F.col("_free"), F.col("_n"))).over(whole)
    t = t.withColumn("_found", level)
    target = F.when(F.col("_found").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_found") * F.col("_w")))
    return t.select("_s", "_size", target.alias("target"))


def _thresholds(rows: DataFrame, parts: DataFrame, small) -> DataFrame:
    """For each (``_k``, ``_b``) of ``parts`` with ``_rest`` tokens to take: the hash at which they run out."""
    edge = parts.where("_rest > 0").select("_k", "_b", "_rest", F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_below"))
    for level in range(BITS // STEP):
        shift = BITS - STEP * (level + 1)
        bucket = F.shiftright("_h", shift)
        inside = rows.withColumnRenamed("_k", "_rk").join(small(edge), (F.col("_rk") == F.col("_k")) & (F.shiftright(F.col("_h"), shift + STEP) == F.col("_prefix")))
        hist = inside.groupBy("_k", "_b", "_rest", "_below", bucket.alias("_bucket")).agg(F.sum("_n").alias("_sum"))
        run = Window.partitionBy("_k", "_b").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("_under", F.col("_below") + F.coalesce(F.sum("_sum").over(run), F.lit(0)))
        edge = hist.where((F.col("_under") <= F.col("_rest")) & (F.col("_under") + F.col("_sum") > F.col("_rest"))).select("_k", "_b", "_rest", F.col("_bucket").alias("_prefix"), F.col("_under").alias("_below"))
    return edge.select("_k", "_b", F.col("_prefix").alias("_until"))


def _key(source_col: str) -> Column:
    return F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))


def _plan(docs: DataFrame, weights: tuple[float, ...], cap: float, budgets: tuple[float, ...], id_col: str, text_col: str, source_col: str):
    """Sizes and places of all rows; for each source its size and, by budget, target, epochs and threshold; how to join the two."""
    rows = materialize(docs.select(F.col(id_col).alias("_id"), _key(source_col).alias("_k"), word_count(F.col(text_col)).alias("_n"), place(F.col(id_col)).alias("_h")), "mix")
    sizes = rows.groupBy("_k").agg(F.sum("_n").alias("_size")).withColumn("_s", F.when(F.col("_k") != "n", F.col("_k")))
    sizes = materialize(sizes, "mix-sources")
    small = F.broadcast if sizes.count() <= BROADCAST_SOURCES else (lambda x: x)
    parts = []
    for b, budget in enumerate(budgets):
        t = source_targets(sizes, weights, cap, budget).withColumn("_k", F.coalesce("_s", F.lit("n")))
        epochs = F.when(F.col("_size") > 0, F.floor(F.col("target") / F.col("_size"))).otherwise(F.lit(0)).cast("long")
        t = t.withColumn("_epochs", epochs).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("_size"))
        parts.append(t.select("_k", F.lit(b).alias("_b"), "_size", "target", "_epochs", "_rest"))
    parts = materialize(reduce(DataFrame.unionAll, parts), "mix-targets")
    plan = parts.join(_thresholds(rows.select("_k", "_n", "_h"), parts, small), ["_k", "_b"], "left")
    one = F.struct("target", "_epochs", F.coalesce("_until", F.lit(0).cast("long")).alias("_until"))
    by_source = plan.groupBy("_k").agg(F.max("_size").alias("source_size"), *[F.max(F.when(F.col("_b") == b, one)).alias(f"_p{b}") for b in range(len(budgets))])
    return rows, materialize(by_source, "mix-plan"), small


def _copies(budget: int) -> Column:
    return F.col(f"_p{budget}._epochs") + F.when(F.col("_h") < F.col(f"_p{budget}._until"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, budgets: tuple[float, ...] = (1.0,), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Words that a mix of the sources takes of each document.

    Sources, in code point order with null last, have the ``weights`` by turns
    and share ``budgets`` times all words; a target never exceeds ``cap`` times
    its source's size, the excess is shared again. A source gives whole epochs
    and then the documents whose hash is below its threshold, which keeps its
    words at or below the target by less than the next document's size.

    Returns ``id_col, size, source_size, target, taken, copies`` with the last
    three for the first budget, then ``taken_2, ...`` for further ones. Sizes
    count ASCII-blank-parted words; a null or empty text has none and takes
    none. Rows with equal ids (null ids too) are taken or left together; if the
    hash at which words run out is shared, that hash is left out. Other columns
    are ignored. An empty table gives an empty result.
    """
    rows, by_source, small = _plan(docs, weights, cap, budgets, id_col, text_col, source_col)
    out = rows.join(small(by_source), "_k")
    more = [(F.col("_n") * _copies(b)).alias(f"taken_{b + 1}") for b in range(1, len(budgets))]
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("size"), "source_size", F.col("_p0.target").alias("target"), (F.col("_n") * _copies(0)).alias("taken"), _copies(0).alias("copies"), *more)


def take(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, budget: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row as often as ``mix`` takes it, with the columns of ``docs``.

    Texts are not shuffled: the small plan is broadcast to them if the sources
    are few. Rows without words are taken as often as their source's hash rule
    says, like any other.
    """
    _, by_source, small = _plan(docs, weights, cap, (budget,), id_col, text_col, source_col)
    fields = [f"`{c}`" for c in docs.columns]
    rows = docs.select(F.struct(*fields).alias("_row"), _key(source_col).alias("_k"), place(F.col(id_col)).alias("_h"))
    out = rows.join(small(by_source.select("_k", "_p0")), "_k").withColumn("_c", _copies(0).cast("int")).where("_c > 0")
    return out.select(F.explode(F.array_repeat("_row", F.col("_c"))).alias("_row")).select("_row.*")
