"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A normalised text is cut at content-defined places into chunks. A chunk's
identifier is its SHA-256 with its length; identifiers are verified, in that
all chunk contents under one identifier are compared byte for byte (the
content itself is part of a grouping key). A document's recipe is the ordered
list of its chunk identifiers, and documents are equal when their recipes are.
Places are decided by a sparse condition on the letters beside them, so after an
insertion texts share chunks again.
Only chunks move, each distinct one about once per task that met it, and
recipes of 40 bytes a chunk; whole documents never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: A chunk has 256 characters at least and 4096 at most. Between, it ends at a blank whose neighbours fall in
#: fixed letter classes, which a word end meets about once in 400 characters: the place depends on these
#: letters alone, so two texts with a common passage soon cut it alike, wherever it stands in them.
CHUNK = r"(?s).{256,4095}?[dglm][aeiou]\s(?=[aeprs])|.{1,4096}"


#: Parts of a group of copies in the join that tells its rows which of them stays.
SALTS = 8


def chunks(text: Column) -> Column:
    """Content-defined chunks of a text, in order; they join to the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipe(chunk_list: Column) -> Column:
    """Ordered identifiers: SHA-256 and length of every chunk."""
    return F.transform(chunk_list, lambda c: F.concat(F.unhex(F.sha2(c, 256)), F.unhex(F.lpad(F.hex(F.octet_length(c)), 8, "0"))))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the group it is in and whether it stays.

    Returns ``id_col, keep_id, group_size, kept, text_sha256``. Texts are equal
    when identical after lower-casing A-Z; null counts as empty, and all empty
    texts are equal. Of a group the row with the largest id stays; among rows
    with that same id, each is marked kept (ids are expected to be unique).
    Null ids sort below all others. An empty table gives an empty result.
    Other columns, whatever their names, are ignored.
    """
    norm = F.coalesce(ascii_lower(F.col(text_col)), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_t"))
    rows = rows.select("_id", F.sha2("_t", 256).alias("_sha"), chunks(F.col("_t")).alias("_c"))
    # Chunk dictionary: the content is a grouping key, so a hash is trusted only
    # after equal bytes were seen; partial aggregation keeps one copy a task.
    contents = rows.select(F.explode("_c").alias("_k")).groupBy(F.sha2("_k", 256).alias("_d"), F.octet_length("_k").alias("_l"), "_k").agg(F.lit(1).alias("_one"))
    clash = contents.groupBy("_d", "_l").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    clash = clash.select(F.concat(F.unhex("_d"), F.unhex(F.lpad(F.hex("_l"), 8, "0"))).alias("_x"))
    listed = materialize(rows.select("_id", "_sha", recipe(F.col("_c")).alias("_r")), "recipes")
    # Identifiers that stand for two contents: none, unless SHA-256 is broken. Their
    # documents must not be merged on trust, so the run stops instead.
    if not clash.isEmpty():
        raise ValueError("two chunk contents share a SHA-256 and length; recipes can't be compared")
    groups = listed.groupBy("_r").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Most texts are alone in their group: their row is the result already. A group of copies is
    # met by a salted join, so that one with a third of all rows is not one task's.
    several = groups.where("group_size > 1").select("_r", "keep_id", "group_size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64("_id", "_sha"), F.lit(SALTS)).cast("int")
    out = listed.withColumn("_salt", salt).join(several, ["_r", "_salt"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("_id")).otherwise(F.col("keep_id"))
    return out.select(F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), F.col("_sha").alias("text_sha256"))
