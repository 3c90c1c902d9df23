"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; a component is its smallest node.

    Each round hooks every node to the neighbour (or itself) that comes first
    in a random order drawn for the round, follows those hooks twice and
    contracts the edges. A round leaves at most about half of the nodes,
    whatever the shape of the graph or the order of ids, and all state is in
    tables in the shared folder. Self loops and repeated edges are fine; null
    ends are dropped; an empty edge table gives an empty result.
    """
    both = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("long"), F.col("b").cast("long")), "links")
    live = materialize(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = materialize(both.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    for r in range(rounds):
        if live.isEmpty():
            break
        order = lambda x: F.xxhash64(F.lit(r), x)  # noqa: B023, E731  drawn anew each round
        either = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = either.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(order(F.col("b")).alias("o"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(order(F.col("node")).alias("o"), F.col("node").alias("v"))
        hook = materialize(best.select("node", F.least("m", own)["v"].alias("up")), "hooks")
        upper = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook2 = materialize(hook.join(upper, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "hooks")
        h = lambda name, to: hook2.select(F.col("node").alias(name), F.col("up").alias(to))  # noqa: B023, E731
        moved = live.join(h("a", "x"), "a").join(h("b", "y"), "b").where("x <> y")
        nxt = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        relabelled = materialize(label.join(h("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        for old in (live, label, hook, hook2):
            discard(old)
        live, label = nxt, relabelled
    else:
        if not live.isEmpty():
            raise RuntimeError("components did not converge")
    smallest = label.groupBy("root").agg(F.min("node").alias("component"))
    return label.join(smallest, "root").select("node", "component")
