"""Coverage, comparison and decision operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import div


def coverage(x: Column | str, mask: Column | None = None) -> Column:
    """Share of rows, or of rows in the mask, with a value."""
    x = F.col(x) if isinstance(x, str) else x
    if mask is None:
        return div(F.count(x), F.count(F.lit(1)))
    m = F.coalesce(mask, F.lit(False))
    return div(F.count_if(m & x.isNotNull()), F.count_if(m))


def summary(x: str) -> list[Column]:
    """Mean and exact order statistics of a column."""
    names = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), *[F.percentile(x, F.lit(q)).alias(k) for k, q in names.items()]]


def compare(expected: DataFrame, observed: DataFrame, keys: list[str], value: str, atol: float = 1e-12, rtol: float = 1e-10) -> DataFrame:
    """Rows present or equal on both sides, by kind: a full outer join with a tolerance."""
    a = expected.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ina"))
    b = observed.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_inb"))
    close = F.abs(F.col("_a") - F.col("_b")) <= atol + rtol * F.abs("_a")
    kind = (
        F.when(F.col("_inb").isNull(), "missing").when(F.col("_ina").isNull(), "extra")
        .when(F.col("_a").isNull() & F.col("_b").isNull(), "equal").when(F.col("_a").isNull() | F.col("_b").isNull(), "null_mismatch")
        .when(close, "equal").otherwise("value_mismatch"))
    return a.join(b, keys, "full_outer").select(*keys, F.col("_a").alias("expected"), F.col("_b").alias("observed"), kind.alias("kind"))


def leaks(panel: DataFrame, build: Callable[[DataFrame], DataFrame], value: str, cutoff, inputs: list[str]) -> DataFrame:
    """Differential test for look-ahead.

    The feature is built on the panel, on the panel cut off after ``cutoff``
    and with later inputs changed; rows up to the cut-off that differ are
    leaks.
    """
    past = F.col("ts") <= F.lit(cutoff)
    whole = build(panel).where(past)
    cut = build(panel.where(past))
    changed = build(panel.withColumns({c: F.when(past, F.col(c)).otherwise(F.col(c) * -3.7 + 11.0) for c in inputs}))
    out = [compare(whole, other.where(past), ["asset", "ts"], value).where("kind <> 'equal'").withColumn("probe", F.lit(name)) for name, other in (("truncated", cut), ("perturbed", changed))]
    return out[0].unionByName(out[1])


def status(checks: dict[str, Column], final: str = "pass", failed: str = "reject") -> list[Column]:
    """A verdict and the failed checks, in order, from named conditions (NULL fails)."""
    bad = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda v: v.isNotNull())
    return [F.when(F.size(bad) == 0, final).otherwise(failed).alias("status"), F.array_join(bad, ",").alias("failed_checks")]


def crash_windows(path: DataFrame, x: str, rows: int, least: int, gap_days: int, top: int, days: int = 3) -> DataFrame:
    """The deepest falls of a rolling sum at least ``gap_days`` apart, with the days around them.

    ``path`` is one series (a row a time). The choice is sequential and exact:
    each of ``top`` rounds takes the deepest row (the earliest of equals) that
    is far enough from those taken, as one aggregate over the series. With fewer
    such rows fewer windows come out.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("ts").rowsBetween(-(rows - 1), 0)
    d = path.withColumn("depth", F.when(F.count(x).over(w) >= least, F.sum(x).over(w))).where("depth IS NOT NULL").select("ts", "depth")
    gap = F.make_dt_interval(F.lit(gap_days))
    taken: list = []
    while len(taken) < top:
        far = d
        for r in taken:
            far = far.where((F.col("ts") >= F.lit(r.ts) + gap) | (F.col("ts") <= F.lit(r.ts) - gap))
        found = far.agg(F.min(F.struct("depth", "ts")).alias("m")).select("m.*").first()
        if found.ts is None:
            break
        taken.append(found)
    spark = path.sparkSession
    found = spark.createDataFrame([(i, r.ts, r.depth) for i, r in enumerate(taken)], "crash int, at timestamp_ntz, depth double")
    step = F.make_dt_interval(F.lit(days))
    return found.withColumn("lo", F.col("at") - step).withColumn("hi", F.col("at") + step)


def book_metrics(levels: DataFrame, keys: list[str], bands: tuple[float, ...] = (5, 10, 25, 50), targets: tuple[float, ...] = (100, 1000, 10000)) -> DataFrame:
    """Spread, depth near the mid, imbalance and sweep impact of order books.

    ``levels``: keys, ``side`` ('bid' or 'ask'), ``price``, ``size`` (notional
    per unit of price is price * size). A sweep takes from each level what is
    left of the target after the better levels: a running sum, no loop.
    """
    d = levels.where((F.col("price") > 0) & (F.col("size") > 0)).withColumn("_v", F.col("price") * F.col("size"))
    better = F.when(F.col("side") == "ask", F.col("price")).otherwise(-F.col("price"))
    run = Window.partitionBy(*keys, "side").orderBy(better).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_before", F.coalesce(F.sum("_v").over(run), F.lit(0.0)))
    side = Window.partitionBy(*keys)  # after the running sum, whose order serves both
    d = d.withColumns({"bid": F.max(F.when(F.col("side") == "bid", F.col("price"))).over(side), "ask": F.min(F.when(F.col("side") == "ask", F.col("price"))).over(side)})
    d = d.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("_bp", F.abs(F.col("price") / F.col("mid") - 1) * 1e4)
    aggs = [F.max("bid").alias("bid"), F.max("ask").alias("ask"), F.max("mid").alias("mid")]
    for s in ("bid", "ask"):
        at = F.col("side") == s
        aggs += [F.coalesce(F.sum(F.when(at & (F.col("_bp") <= b), F.col("_v"))), F.lit(0.0)).alias(f"{s}_depth_{b:g}") for b in bands]
        for t in targets:
            part = F.greatest(F.lit(0.0), F.least(F.col("_v"), F.lit(float(t)) - F.col("_before")))
            aggs += [F.sum(F.when(at, part)).alias(f"_{s}_quote_{t:g}"), F.sum(F.when(at, part / F.col("price"))).alias(f"_{s}_base_{t:g}")]
    g = d.groupBy(*keys).agg(*aggs)
    out = [*keys, "bid", "ask", "mid", (div(F.col("ask") - F.col("bid"), "mid") * 1e4).alias("spread_bp")]
    for b in bands:
        x, y = F.col(f"bid_depth_{b:g}"), F.col(f"ask_depth_{b:g}")
        out += [x, y, div(x - y, x + y).alias(f"imbalance_{b:g}")]
    for t in targets:
        for s, sign in (("ask", 1), ("bid", -1)):
            q, base = F.col(f"_{s}_quote_{t:g}"), F.col(f"_{s}_base_{t:g}")
            out += [(q / t).alias(f"{s}_fill_{t:g}"), F.when(q / t >= 1 - 1e-9, sign * (div(q, base) / F.col("mid") - 1) * 1e4).alias(f"{s}_impact_{t:g}")]
    return g.select(*out)
