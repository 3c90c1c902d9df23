"""Append-only ledgers: candidates and their trials, runs and their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States in the order of a candidate's progress (fixed values).
ORDER = ("registered", "screened", "watchlist", "passed", "rejected")
REQUIRED = ("candidate_id", "source_ids", "hypothesis", "family", "required_fields", "panel_formula", "direction", "neutralization", "bucket_policy", "weighting_modes", "generated_by")


def trial_counts(log: DataFrame, by: str) -> DataFrame:
    """Variants tried: the most of each candidate, then summed by ``by``."""
    one = log.groupBy("candidate", by).agg(F.max("variant_count").alias("_v"))
    return one.groupBy(by).agg(F.sum("_v").alias("variants"), F.count(F.lit(1)).alias("candidates"))


def source_counts(log: DataFrame) -> DataFrame:
    """The same by source, each (source, candidate) once."""
    one = log.select("candidate", F.explode("source_ids").alias("source"), "variant_count").groupBy("source", "candidate").agg(F.max("variant_count").alias("_v"))
    return one.groupBy("source").agg(F.sum("_v").alias("variants"), F.count(F.lit(1)).alias("candidates"))


def latest(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """An index from an event log: the fields of each key's last event."""
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_l"), F.count(F.lit(1)).alias("n_events")).select(key, "_l.*", "n_events")


def best_status(events: DataFrame, key: str, state: str, order: tuple[str, ...]) -> DataFrame:
    """The furthest state of each key in a given order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(state))
    return events.groupBy(key).agg(F.max(rank).alias("_r")).select(key, F.element_at(F.array(*[F.lit(s) for s in order]), F.greatest(F.col("_r"), F.lit(1)).cast("int")).alias("best_state"), F.col("_r").alias("level"))


def conflicts(log: DataFrame) -> DataFrame:
    """Candidates registered under more than one signature."""
    return log.groupBy("candidate").agg(F.count_distinct("signature").alias("n")).where("n > 1")


def signature(*parts: Column) -> Column:
    """A canonical text of a candidate: arrays sorted, parts joined."""
    return F.concat_ws("|", *parts)


def family_budget(proposals: DataFrame, used: DataFrame, most: int) -> DataFrame:
    """Proposals with what their family had and has used when their turn comes, and whether they fit."""
    w = Window.partitionBy("family").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    d = proposals.join(used.select("family", "used"), "family", "left").withColumn("running", F.coalesce("used", F.lit(0)) + F.sum("variant_count").over(w))
    return d.withColumn("accepted", F.col("running") <= most)


def next_source(sources: DataFrame, used: DataFrame, lifetime: int) -> DataFrame:
    """The admitted source that has used least of its budget."""
    d = sources.where("admitted").join(used, "source", "left").withColumn("n", F.coalesce("variants", F.lit(0)))
    return d.where(F.col("n") < lifetime).orderBy("n", "source").select("source", "n").limit(1)


def query_runs(runs: DataFrame, limit: int = 100, **equal: str | None) -> DataFrame:
    """Runs by the filters given, newest first, at most 10,000."""
    for c, v in equal.items():
        if v is not None:
            runs = runs.where(F.col(c) == v)
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(min(max(limit, 1), 10_000))


def row_hash(*columns: str) -> Column:
    """SHA-256 of the columns as canonical text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def frame_fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One order-free value of a table: count, and exclusive or and sum of 64-bit row hashes."""
    h = F.xxhash64(*columns)
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("xor"), F.sum(F.shiftright(h, 16)).alias("sum"))
