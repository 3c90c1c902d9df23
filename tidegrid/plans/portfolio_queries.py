"""Queries across assets, and over portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import asset_time, change, correlation, div, forward, lag, pair_moments, rolling
from ..operators import crosssection as xs
from ..operators import grid, recursive
from ..operators import portfolio as pf
from ..operators import timeseries as ts
from .panels import EVENT_HOURS, NATION_DAY, NATION_MONTH, SUPPLIER_MONTH, event_grid, nation_day, nation_month, rounded, rounding, supplier_month

W = "PARTITION BY asset ORDER BY ts"
#: SQL shared by most: month features of nations.
FEATURES = NATION_MONTH + f""",
f AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r, close / lag(close, 3) OVER ({W}) - 1 AS mom, lead(close) OVER ({W}) / close - 1 AS fwd,
  ln(vol_quote) AS size FROM p)"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    p = nation_month(spark, sf)
    return p.select("*", change("close").alias("r"), change("close", 3).alias("mom"), forward("close", 1).alias("fwd"), F.log("vol_quote").alias("size"))


def momentum_pnl(spark: SparkSession, sf: str) -> DataFrame:
    """Nation-month momentum, rank weights, one month of lag, costs: net P&L by month."""
    p = pf.rank_weights(features(spark, sf), "mom", 5, "w").withColumn("h", pf.held("w"))
    return rounded(pf.pnl(p, "h", "r").select("ts", "gross", "turnover", "cost", "net", F.col("missing").alias("n_missing")), 8)


def rank_ic_global(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(xs.rank_ic(features(spark, sf), "mom", "fwd", 5, False))


def rank_ic_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(xs.rank_ic(features(spark, sf), "mom", "fwd", 5, True))


def _avg_rank_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY ts ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY ts, {x}) - 1) / 2.0::DOUBLE END"


def _ic_sql(where: str) -> str:
    return rounding(FEATURES + f""", a AS (SELECT ts, {_avg_rank_sql("mom")} AS x, {_avg_rank_sql("fwd")} AS y FROM f {where}),
      g AS (SELECT ts, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n_pairs, CASE WHEN count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) >= 5 THEN corr(x, y) END AS ic0 FROM a GROUP BY ts),
      z AS (SELECT ts, n_pairs, CASE WHEN isnan(ic0) THEN NULL ELSE ic0 END AS ic FROM g)""", "ic", "ts, n_pairs")


def xs_pct_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features(spark, sf).select("asset", "ts", xs.pct_rank(F.round("mom", 2)).alias("pct"), xs.standardize("mom").alias("std")))


def xs_residual(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(xs.residual(features(spark, sf), "mom", "size", 5, "res").select("asset", "ts", "res"))


def xs_bucket_neutral(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(xs.bucket_neutral(features(spark, sf), "mom", "size", 5, "neutral").select("asset", "ts", "neutral"))


def xs_family_neutral(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(xs.family_neutral(features(spark, sf), "mom", "family", "neutral").select("asset", "ts", "neutral"))


def candidate_controls(spark: SparkSession, sf: str) -> DataFrame:
    """A candidate: residual on size, among the 15 largest, short."""
    p = features(spark, sf).withColumn("eligible", F.col("volume") >= 3)
    spec = {"eligible": "eligible", "size": "size", "neutralization": "residual", "bucket_policy": "large_liquid", "top": 15, "direction": "short", "least": 5}
    return rounded(xs.apply_controls(p, "mom", spec, "signal").select("asset", "ts", "signal"))


def universe_topn(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier months: the 40 largest by trailing turnover among those seen for a year."""
    p = supplier_month(spark, sf)
    p = p.withColumn("seen", F.count("close").over(asset_time().rowsBetween(Window.unboundedPreceding, 0))).withColumn("prev", lag("vol_quote"))
    p = p.withColumn("liq", rolling(F.sum, "prev", 6, 3))
    base = F.col("close").isNotNull() & (F.col("seen") >= 12) & F.col("liq").isNotNull()
    return rounded(p.select("asset", "ts", xs.top_n("liq", base, 40).alias("top"), xs.top_n("liq", base, 10, largest=False).alias("bottom"), xs.at_least_median("liq", base).alias("upper_half")))


def rank_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pf.rank_weights(features(spark, sf), "mom", 5, "w").select("asset", "ts", "w"), 8)


def top_bottom_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pf.top_bottom_weights(features(spark, sf), "mom", 5, 0.3, "w").select("asset", "ts", "w"), 8)


def vw_30_40_30(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pf.segment_weights(features(spark, sf), "mom", "vol_quote", 0.3, 5, "w").select("asset", "ts", "w"), 8)


def quintile_ew(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pf.segment_weights(features(spark, sf), "mom", "vol_quote", 0.2, 5, "w", equal=True, apart=True).select("asset", "ts", "w"), 8)


def segment_sql(source: str, x: str, cap: str, share: float, part: str = "ts", apart: bool = False) -> str:
    """CTE ``sw``: outer shares of x held half long and half short, by cap; equal values by asset, short where both meet."""
    above = "up > n - k AND 2 * k <= n" if apart else "dn <= k"
    below = "up <= k AND 2 * k <= n" if apart else "up <= k"
    return f"""s0 AS (SELECT *, count({x}) OVER (PARTITION BY {part}) AS n, row_number() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST, asset) AS up, row_number() OVER (PARTITION BY {part} ORDER BY {x} DESC NULLS LAST, asset) AS dn FROM {source}),
      s1 AS (SELECT *, greatest(1, floor(n * {share}::DOUBLE)) AS k FROM s0), s2 AS (SELECT *, {x} IS NOT NULL AND n >= 5 AND {below} AS lo, {x} IS NOT NULL AND n >= 5 AND {above} AS hi FROM s1),
      sw AS (SELECT *, CASE WHEN lo THEN -0.5::DOUBLE * {cap} / sum({cap}) FILTER (WHERE lo) OVER (PARTITION BY {part}) WHEN hi THEN 0.5::DOUBLE * {cap} / sum({cap}) FILTER (WHERE hi) OVER (PARTITION BY {part}) ELSE 0 END AS w FROM s2)"""


def _day_signal(spark: SparkSession, sf: str) -> DataFrame:
    p = nation_day(spark, sf).withColumn("close", grid.fill_forward("close"))
    return p.withColumn("r", change("close")).withColumn("mom", change("close", 20))


DAY = NATION_DAY + f""", q AS (SELECT asset, family, ts, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close, volume FROM p),
f AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r, close / lag(close, 20) OVER ({W}) - 1 AS mom FROM q)"""
_RANKW = f"""a AS (SELECT *, CASE WHEN count(mom) OVER (PARTITION BY ts) >= 5 THEN ({_avg_rank_sql("mom")}) / count(mom) OVER (PARTITION BY ts) - 0.5::DOUBLE END AS p0 FROM f),
  b AS (SELECT *, p0 - avg(p0) OVER (PARTITION BY ts) AS p1 FROM a),
  rw AS (SELECT *, coalesce(p1 / nullif(sum(abs(p1)) OVER (PARTITION BY ts), 0), 0) AS w FROM b)"""
_REBAL = f"""c AS (SELECT *, coalesce(floor(epoch(ts) / 604800) <> floor(epoch(lag(ts) OVER ({W})) / 604800), true) AS u FROM rw),
  d AS (SELECT *, last_value(CASE WHEN u THEN w END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rb FROM c),
  hw AS (SELECT *, coalesce(lag(rb) OVER ({W}), 0) AS h FROM d)"""


def _weekly(spark: SparkSession, sf: str) -> DataFrame:
    p = pf.rank_weights(_day_signal(spark, sf), "mom", 5, "w").withColumn("rb", pf.rebalance("w", 168))
    return p.withColumn("h", pf.held("rb"))


def rebalance_hold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_weekly(spark, sf).select("asset", "ts", "rb", "h"), 8)


def _split_path(spark: SparkSession, sf: str) -> DataFrame:
    p = _weekly(spark, sf)
    return pf.pnl(p.join(grid.splits(p).select("ts", "split"), "ts"), "h", "r", part=("split",))


_PATH = f"""t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM f)),
  s AS (SELECT ts, CASE WHEN pos < floor(n * 0.5::DOUBLE) THEN 'is' WHEN pos < floor(n * 0.5::DOUBLE) + floor(n * 0.17::DOUBLE) THEN 'val' ELSE 'holdout' END AS split FROM t),
  e AS (SELECT hw.*, s.split, abs(h - coalesce(lag(h) OVER (PARTITION BY asset, s.split ORDER BY hw.ts), 0)) AS tn FROM hw JOIN s ON hw.ts = s.ts),
  path AS (SELECT split, ts, coalesce(sum(h * r), 0) AS gross, sum(tn) AS turnover, sum(tn) * 7 / 10000 AS cost, coalesce(sum(h * r), 0) - sum(tn) * 7 / 10000 AS net, count(*) FILTER (WHERE r IS NULL AND abs(h) > 1e-12) AS missing FROM e GROUP BY split, ts)"""


def turnover_cost_pnl(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_split_path(spark, sf).select("split", "ts", "gross", "turnover", "cost", "net", F.col("missing").alias("n_missing")), 8)


def portfolio_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = pf.metrics(_split_path(spark, sf), 365, ("split",))
    return rounded(m.select("split", "n", "total", "mean", "sharpe", "max_drawdown", "avg_turnover", "cost", "hit_rate", "compounded"))


def daily_rollup_pnl(spark: SparkSession, sf: str) -> DataFrame:
    """P&L by month with a calendar spine, and its running peak and drawdown."""
    d = _split_path(spark, sf).groupBy(F.last_day("ts").alias("month")).agg(F.sum("net").alias("net"), F.count(F.lit(1)).alias("n_days"))
    ends = d.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    spine = ends.select(F.explode(F.sequence(F.trunc("a", "MM"), F.col("b"), F.expr("interval 1 month"))).alias("m")).select(F.last_day("m").alias("month"))
    d = spine.join(d, "month", "left").select("month", F.coalesce("net", F.lit(0.0)).alias("net"), F.coalesce("n_days", F.lit(0)).alias("n_days"))
    return rounded(ts.drawdown(d, "net", "month"))


def formation_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Which days are Mondays, and which month ends."""
    t = nation_day(spark, sf).select("ts").distinct()
    return t.select("ts", (F.dayofweek("ts") == 2).alias("weekly"), (F.last_day("ts") == F.to_date("ts")).alias("monthly"))


def formation_execution(spark: SparkSession, sf: str) -> DataFrame:
    """Weights formed on Mondays, live two rows later for at most five rows."""
    p = pf.rank_weights(_day_signal(spark, sf), "mom", 5, "w")
    formed = p.where(F.dayofweek("ts") == 2).select("asset", "ts", "w")
    return rounded(pf.execute_formations(p.select("asset", "ts"), formed, "w", 2, 5).select("asset", "ts", "w"), 8)


def pair_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Long a leg and short its twin: forward return less the forward sum of carry."""
    p = nation_month(spark, sf).withColumn("leg2", F.col("vol_quote") / F.col("volume") * 1.01).withColumn("carry", F.col("volume") / 1e5)
    coming = F.sum("carry").over(asset_time().rowsBetween(1, 2))
    return rounded(p.select("asset", "ts", (forward("close", 2) - forward("leg2", 2) + coming).alias("pair_return"), div("close", "leg2").alias("ratio"), (div("close", "leg2") - 1).alias("basis")), 8)


def topn_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Equal weights in the five assets of the highest mean rank of basis and volume, positive ones only; P&L on both legs."""
    p = features(spark, sf).withColumn("basis", F.when(F.col("mom") > 0, F.col("mom")))
    p = p.withColumn("score", (xs.pct_rank("basis") + xs.pct_rank(F.when(F.col("basis").isNotNull(), F.col("volume")))) / 2)
    p = p.withColumn("in", xs.top_n("score", F.col("score").isNotNull(), 5)).withColumn("w", F.when(F.col("in"), F.lit(0.2)).otherwise(F.lit(0.0)))
    p = p.withColumn("h", pf.held("w"))
    out = pf.pnl(p, "h", "r", cost_bp=2 * 7.0)
    return rounded(out.select("ts", "gross", "turnover", "cost", "net"), 8)


def _single(spark: SparkSession, sf: str) -> DataFrame:
    p = event_grid(spark, sf).withColumn("close", grid.fill_forward("close"))
    p = p.withColumn("r", change("close")).withColumn("sig", -change("close", 3))
    p = p.withColumn("pos", ts.position("sig", 48, 12)).withColumn("held", F.coalesce(lag("pos"), F.lit(0.0)))
    p = p.withColumn("cost", F.abs(F.col("held") - F.coalesce(lag("held"), F.lit(0.0))) * 7 / 1e4)
    n = F.row_number().over(asset_time())
    return p.withColumn("funding", F.when((n - 1) % 8 == 0, F.col("held") * 1e-4).otherwise(0.0)).withColumn("pnl", F.coalesce(F.col("held") * F.col("r"), F.lit(0.0)) - F.col("cost") - F.col("funding"))


SINGLE = EVENT_HOURS + f""", q AS (SELECT asset, ts, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM p),
f0 AS (SELECT *, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r, -(close / nullif(lag(close, 3) OVER ({W}), 0) - 1) AS sig FROM q),
g AS (SELECT *, count(sig) OVER w AS k, avg(sig) OVER w AS m, stddev_samp(sig) OVER w AS sd FROM f0 WINDOW w AS ({W} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)),
h AS (SELECT *, CASE WHEN k >= 12 AND sig IS NOT NULL AND sd > 1e-12 THEN greatest(-1, least(1, (sig - m) / sd)) ELSE 0 END AS pos FROM g),
i AS (SELECT *, coalesce(lag(pos) OVER ({W}), 0) AS held, row_number() OVER ({W}) AS n FROM h),
j AS (SELECT *, abs(held - coalesce(lag(held) OVER ({W}), 0)) * 7 / 10000 AS cost, CASE WHEN (n - 1) % 8 = 0 THEN held * 1e-4 ELSE 0 END AS funding FROM i),
f AS (SELECT *, coalesce(held * r, 0) - cost - funding AS pnl FROM j)"""


def backtest_single(spark: SparkSession, sf: str) -> DataFrame:
    """One asset at a time: z-position, one row of lag, costs, funding every eighth row."""
    p = ts.drawdown(_single(spark, sf), "pnl", part=["asset"])
    sign = F.when((F.col("held") != 0) & (F.col("r") != 0), (F.signum("held") == F.signum("r")).cast("double"))
    out = p.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("total"), pf.sharpe("pnl", 8760).alias("sharpe"), F.max("drawdown").alias("max_drawdown"), F.avg(sign).alias("accuracy"), F.sum("cost").alias("cost"), F.avg(F.abs("held")).alias("exposure"))
    return rounded(out)


def bucket_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Mean return by value quintile of the signal, and the spread of the outer two."""
    p = _single(spark, sf).where(F.col("sig").isNotNull() & F.col("r").isNotNull())
    edges = p.groupBy("asset").agg(F.percentile("sig", F.array(*[F.lit(q) for q in (0.2, 0.4, 0.6, 0.8)])).alias("e"))
    b = F.size(F.filter("e", lambda e: F.col("sig") > e))
    out = p.join(edges, "asset").groupBy("asset", b.cast("long").alias("bucket")).agg(F.avg("r").alias("mean_return"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("asset").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rounded(out.withColumn("spread", F.last("mean_return").over(w) - F.first("mean_return").over(w)))


def cost_stress(spark: SparkSession, sf: str) -> DataFrame:
    """Totals under one to three times the cost."""
    m = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "multiple double")
    p = _single(spark, sf).groupBy("asset").agg(F.sum("pnl").alias("t"), F.sum("cost").alias("c"))
    return rounded(p.crossJoin(F.broadcast(m)).select("asset", "multiple", (F.col("t") - (F.col("multiple") - 1) * F.col("c")).alias("total")))


def combos(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the ten smoothest nations whose P&L is little correlated, with the pair's Sharpe."""
    p = features(spark, sf).withColumn("pnl", F.coalesce(F.coalesce(F.signum(lag("mom")), F.lit(0.0)) * F.col("r"), F.lit(0.0)))
    pool = p.groupBy("asset").agg(pf.sharpe("pnl", 12).alias("s")).orderBy(F.desc("s"), "asset").limit(10).select("asset")
    x = p.join(F.broadcast(pool), "asset").select("asset", "ts", "pnl")  # ten rows
    y = x.select(F.col("asset").alias("b"), "ts", F.col("pnl").alias("q"))
    both = x.withColumnRenamed("asset", "a").join(y, "ts").where("a < b")  # pairs of the pool at one time
    out = both.groupBy("a", "b").agg(correlation(*pair_moments(F.col("pnl"), F.col("q"))).alias("corr"), pf.sharpe((F.col("pnl") + F.col("q")) / 2, 12).alias("sharpe"))
    return rounded(out.where(F.abs("corr") <= 0.75))


def hysteresis_members(spark: SparkSession, sf: str) -> DataFrame:
    """Members by rank of momentum: in at 3, kept to 6."""
    p = features(spark, sf).where("mom IS NOT NULL").withColumn("book", F.lit("all")).withColumn("rk", F.row_number().over(xs.at().orderBy(F.desc("mom"), "asset")).cast("double"))
    return recursive.hysteresis(p, "rk", 3, 6).select("ts", "asset", "member")


def residual_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Momentum on size and volume, by pseudo-inverse at each month."""
    return rounded(xs.residualize(features(spark, sf), "mom", ["size", "volume"], 8, "res").select("asset", "ts", "res"), 5)


QUERIES = {
    "momentum_pnl": (momentum_pnl, rounding(FEATURES + ", " + _RANKW + f""", hw AS (SELECT *, coalesce(lag(w) OVER ({W}), 0) AS h FROM rw),
      e AS (SELECT *, abs(h - coalesce(lag(h) OVER ({W}), 0)) AS tn FROM hw),
      z AS (SELECT ts, coalesce(sum(h * r), 0) AS gross, sum(tn) AS turnover, sum(tn) * 7 / 10000 AS cost, coalesce(sum(h * r), 0) - sum(tn) * 7 / 10000 AS net, count(*) FILTER (WHERE r IS NULL AND abs(h) > 1e-12) AS n_missing FROM e GROUP BY ts)""", "gross, turnover, cost, net", "ts, n_missing", 8)),
    "rank_ic_global": (rank_ic_global, _ic_sql("")),
    "rank_ic_pairwise": (rank_ic_pairwise, _ic_sql("WHERE mom IS NOT NULL AND fwd IS NOT NULL")),
    "xs_pct_rank": (xs_pct_rank, rounding(FEATURES + f""", a AS (SELECT *, round(mom, 2) AS m2 FROM f), z AS (SELECT asset, ts, ({_avg_rank_sql("m2")}) / count(m2) OVER (PARTITION BY ts) AS pct, (mom - avg(mom) OVER (PARTITION BY ts)) / nullif(stddev_samp(mom) OVER (PARTITION BY ts), 0) AS std FROM a)""", "pct, std", "asset, ts")),
    "xs_residual": (xs_residual, rounding(FEATURES + """, a AS (SELECT *, regr_slope(mom, size) OVER (PARTITION BY ts) AS b, avg(mom) FILTER (WHERE size IS NOT NULL) OVER (PARTITION BY ts) AS my, avg(size) FILTER (WHERE mom IS NOT NULL) OVER (PARTITION BY ts) AS mx, count(mom) FILTER (WHERE size IS NOT NULL) OVER (PARTITION BY ts) AS n FROM f),
      z AS (SELECT asset, ts, CASE WHEN n >= 5 THEN mom - my - b * (size - mx) END AS res FROM a)""", "res", "asset, ts")),
    "xs_bucket_neutral": (xs_bucket_neutral, rounding(FEATURES + """, a AS (SELECT *, CASE WHEN mom IS NOT NULL THEN size END AS s FROM f),
      b AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY s NULLS LAST, asset) AS rn, count(s) OVER (PARTITION BY ts) AS n FROM a),
      c AS (SELECT *, CASE WHEN s IS NOT NULL AND n >= 5 THEN least(2, floor((rn - 1) * 3 / (n - 1)::DOUBLE)) END AS k FROM b),
      d AS (SELECT *, CASE WHEN k IS NOT NULL THEN mom END AS v FROM c),
      z AS (SELECT asset, ts, CASE WHEN count(v) OVER (PARTITION BY ts, k) > 1 THEN v - avg(v) OVER (PARTITION BY ts, k) END AS neutral FROM d)""", "neutral", "asset, ts")),
    "xs_family_neutral": (xs_family_neutral, rounding(FEATURES + """, n AS (SELECT family, count(DISTINCT asset) AS k FROM f GROUP BY family), z AS (SELECT asset, ts, CASE WHEN k >= 2 THEN mom - avg(mom) OVER (PARTITION BY ts, f.family) END AS neutral FROM f JOIN n ON f.family = n.family)""", "neutral", "asset, ts")),
    "candidate_controls": (candidate_controls, rounding(FEATURES + """, e AS (SELECT *, CASE WHEN volume >= 3 THEN mom END AS m FROM f),
      a AS (SELECT *, regr_slope(m, size) OVER (PARTITION BY ts) AS b, avg(m) FILTER (WHERE size IS NOT NULL) OVER (PARTITION BY ts) AS my, avg(size) FILTER (WHERE m IS NOT NULL) OVER (PARTITION BY ts) AS mx, count(m) FILTER (WHERE size IS NOT NULL) OVER (PARTITION BY ts) AS n FROM e),
      c AS (SELECT *, CASE WHEN n >= 5 THEN m - my - b * (size - mx) END AS res FROM a),
      d AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY CASE WHEN res IS NOT NULL THEN size END DESC NULLS LAST, asset) AS rn FROM c),
      z AS (SELECT asset, ts, CASE WHEN rn <= 15 THEN -1 * res END AS signal FROM d)""", "signal", "asset, ts")),
    "universe_topn": (universe_topn, "WITH " + SUPPLIER_MONTH.strip() + f""", a AS (SELECT *, count(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen, lag(vol_quote) OVER ({W}) AS prev FROM p),
      b AS (SELECT *, CASE WHEN count(prev) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) >= 3 THEN sum(prev) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END AS liq FROM a),
      c AS (SELECT *, CASE WHEN close IS NOT NULL AND seen >= 12 THEN liq END AS v FROM b)
      SELECT asset, ts, coalesce(v IS NOT NULL AND row_number() OVER (PARTITION BY ts ORDER BY v DESC NULLS LAST, asset) <= 40, false) AS top, coalesce(v IS NOT NULL AND row_number() OVER (PARTITION BY ts ORDER BY v NULLS LAST, asset) <= 10, false) AS bottom, coalesce(v >= quantile_cont(v, 0.5) OVER (PARTITION BY ts), false) AS upper_half FROM c"""),
    "rank_weights": (rank_weights, rounding(FEATURES + ", " + _RANKW + ", z AS (SELECT * FROM rw)", "w", "asset, ts", 8)),
    "top_bottom_weights": (top_bottom_weights, rounding(FEATURES + """, a AS (SELECT *, count(mom) OVER (PARTITION BY ts) AS n, row_number() OVER (PARTITION BY ts ORDER BY mom NULLS LAST, asset) AS up, row_number() OVER (PARTITION BY ts ORDER BY mom DESC NULLS LAST, asset) AS dn FROM f),
      b AS (SELECT *, greatest(1, floor(n * 0.3::DOUBLE)) AS k FROM a), z AS (SELECT asset, ts, CASE WHEN n >= 5 AND mom IS NOT NULL THEN CASE WHEN up <= k THEN -0.5 / k WHEN dn <= k THEN 0.5 / k ELSE 0 END ELSE 0 END AS w FROM b)""", "w", "asset, ts", 8)),
    "vw_30_40_30": (vw_30_40_30, rounding(FEATURES + ", a AS (SELECT * REPLACE (CASE WHEN vol_quote > 0 THEN mom END AS mom) FROM f), " + segment_sql("a", "mom", "vol_quote", 0.3) + ", z AS (SELECT asset, ts, w FROM sw)", "w", "asset, ts", 8)),
    "quintile_ew": (quintile_ew, rounding(FEATURES + ", a AS (SELECT * REPLACE (CASE WHEN vol_quote > 0 THEN mom END AS mom) FROM f), " + segment_sql("a", "mom", "1.0::DOUBLE", 0.2, apart=True) + ", z AS (SELECT asset, ts, w FROM sw)", "w", "asset, ts", 8)),
    "rebalance_hold": (rebalance_hold, rounding(f"{DAY}, {_RANKW}, {_REBAL}, z AS (SELECT * FROM hw)", "rb, h", "asset, ts", 8)),
    "turnover_cost_pnl": (turnover_cost_pnl, rounding(f"{DAY}, {_RANKW}, {_REBAL}, {_PATH}, z AS (SELECT *, missing AS n_missing FROM path)", "gross, turnover, cost, net", "split, ts, n_missing", 8)),
    "portfolio_metrics": (portfolio_metrics, rounding(f"""{DAY}, {_RANKW}, {_REBAL}, {_PATH}, c1 AS (SELECT *, sum(net) OVER (PARTITION BY split ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM path),
      c2 AS (SELECT *, max(cum) OVER (PARTITION BY split ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cum AS dd FROM c1),
      z AS (SELECT split, count(*) AS n, sum(net) AS total, avg(net) AS mean, avg(net) / stddev_samp(net) * sqrt(365.0::DOUBLE) AS sharpe, max(dd) AS max_drawdown, avg(turnover) AS avg_turnover, sum(cost) AS cost, avg(CASE WHEN net > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate, exp(sum(ln(CASE WHEN net > -1 THEN 1 + net END))) - 1 AS compounded FROM c2 GROUP BY split)""", "total, mean, sharpe, max_drawdown, avg_turnover, cost, hit_rate, compounded", "split, n")),
    "daily_rollup_pnl": (daily_rollup_pnl, rounding(f"""{DAY}, {_RANKW}, {_REBAL}, {_PATH}, m AS (SELECT last_day(ts) AS month, sum(net) AS net, count(*) AS n_days FROM path GROUP BY last_day(ts)),
      s2 AS (SELECT last_day(unnest(generate_series((SELECT date_trunc('month', min(month)) FROM m)::TIMESTAMP, (SELECT max(month) FROM m)::TIMESTAMP, INTERVAL 1 MONTH))) AS month),
      c1 AS (SELECT month, coalesce(net, 0) AS net, coalesce(n_days, 0) AS n_days FROM s2 LEFT JOIN m USING (month)), c2 AS (SELECT *, sum(net) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pnl FROM c1),
      c3 AS (SELECT *, max(cum_pnl) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM c2), z AS (SELECT *, peak - cum_pnl AS drawdown FROM c3)""", "net, cum_pnl, peak, drawdown", "month, n_days")),
    "formation_filters": (formation_filters, "WITH " + NATION_DAY.strip() + " SELECT DISTINCT ts, dayofweek(ts) = 1 AS weekly, last_day(ts) = ts::DATE AS monthly FROM p"),
    "formation_execution": (formation_execution, rounding(f"""{DAY}, {_RANKW}, i AS (SELECT *, row_number() OVER ({W}) AS i FROM rw),
      l AS (SELECT *, last_value(CASE WHEN dayofweek(ts) = 1 THEN i END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li, last_value(CASE WHEN dayofweek(ts) = 1 THEN w END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lw FROM i),
      z AS (SELECT asset, ts, coalesce(CASE WHEN i - 2 - lag(li, 2) OVER ({W}) < 5 THEN lag(lw, 2) OVER ({W}) END, 0) AS w FROM l)""", "w", "asset, ts", 8)),
    "pair_forward": (pair_forward, rounding(NATION_MONTH + f""", a AS (SELECT *, vol_quote / volume * 1.01::DOUBLE AS leg2, volume / 1e5 AS carry FROM p),
      z AS (SELECT asset, ts, (lead(close, 2) OVER ({W}) / close - 1) - (lead(leg2, 2) OVER ({W}) / leg2 - 1) + sum(carry) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS pair_return, close / leg2 AS ratio, close / leg2 - 1 AS basis FROM a)""", "pair_return, ratio, basis", "asset, ts", 8)),
    "topn_pair": (topn_pair, rounding(FEATURES + f""", a AS (SELECT *, CASE WHEN mom > 0 THEN mom END AS b0, CASE WHEN mom > 0 THEN volume END AS v0 FROM f),
      b AS (SELECT *, (({_avg_rank_sql("b0")}) / count(b0) OVER (PARTITION BY ts) + ({_avg_rank_sql("v0")}) / count(v0) OVER (PARTITION BY ts)) / 2 AS score FROM a),
      c AS (SELECT *, CASE WHEN score IS NOT NULL AND row_number() OVER (PARTITION BY ts ORDER BY score DESC NULLS LAST, asset) <= 5 THEN 0.2::DOUBLE ELSE 0 END AS w FROM b),
      hw AS (SELECT *, coalesce(lag(w) OVER ({W}), 0) AS h FROM c), e AS (SELECT *, abs(h - coalesce(lag(h) OVER ({W}), 0)) AS tn FROM hw),
      z AS (SELECT ts, coalesce(sum(h * r), 0) AS gross, sum(tn) AS turnover, sum(tn) * 14 / 10000 AS cost, coalesce(sum(h * r), 0) - sum(tn) * 14 / 10000 AS net FROM e GROUP BY ts)""", "gross, turnover, cost, net", "ts", 8)),
    "backtest_single": (backtest_single, rounding(SINGLE + f""", c1 AS (SELECT *, sum(pnl) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM f), c2 AS (SELECT *, max(cum) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cum AS dd FROM c1),
      z AS (SELECT asset, count(*) AS n, sum(pnl) AS total, avg(pnl) / stddev_samp(pnl) * sqrt(8760.0::DOUBLE) AS sharpe, max(dd) AS max_drawdown, avg(CASE WHEN held <> 0 AND r <> 0 THEN CASE WHEN sign(held) = sign(r) THEN 1.0::DOUBLE ELSE 0 END END) AS accuracy, sum(cost) AS cost, avg(abs(held)) AS exposure FROM c2 GROUP BY asset)""", "total, sharpe, max_drawdown, accuracy, cost, exposure", "asset, n")),
    "bucket_returns": (bucket_returns, rounding(SINGLE + """, a AS (SELECT *, quantile_cont(sig, [0.2, 0.4, 0.6, 0.8]) OVER (PARTITION BY asset) AS e FROM f WHERE sig IS NOT NULL AND r IS NOT NULL),
      b AS (SELECT asset, CAST(len(list_filter(e, lambda x: sig > x)) AS BIGINT) AS bucket, r FROM a), c AS (SELECT asset, bucket, avg(r) AS mean_return, count(*) AS n FROM b GROUP BY ALL),
      z AS (SELECT *, last_value(mean_return) OVER w - first_value(mean_return) OVER w AS spread FROM c WINDOW w AS (PARTITION BY asset ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""", "mean_return, spread", "asset, bucket, n")),
    "cost_stress": (cost_stress, rounding(SINGLE + """, a AS (SELECT asset, sum(pnl) AS t, sum(cost) AS c FROM f GROUP BY asset), z AS (SELECT asset, multiple, t - (multiple - 1) * c AS total FROM a CROSS JOIN (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE]) AS multiple))""", "multiple, total", "asset")),
    "combos": (combos, rounding(FEATURES + f""", a AS (SELECT asset, ts, coalesce(coalesce(sign(lag(mom) OVER ({W})), 0) * r, 0) AS pnl FROM f),
      b AS (SELECT asset, avg(pnl) / stddev_samp(pnl) * sqrt(12.0::DOUBLE) AS s FROM a GROUP BY asset ORDER BY s DESC, asset LIMIT 10), x AS (SELECT a.* FROM a JOIN b USING (asset)),
      c AS (SELECT x.asset AS a, y.asset AS b, corr(x.pnl, y.pnl) AS corr, avg((x.pnl + y.pnl) / 2) / stddev_samp((x.pnl + y.pnl) / 2) * sqrt(12.0::DOUBLE) AS sharpe FROM x JOIN x y ON x.ts = y.ts AND x.asset < y.asset GROUP BY ALL), z AS (SELECT * FROM c WHERE abs(corr) <= 0.75)""", "corr, sharpe", "a, b")),
    "hysteresis_members": (hysteresis_members, "WITH RECURSIVE " + FEATURES.strip() + """, rk AS (SELECT ts, asset, row_number() OVER (PARTITION BY ts ORDER BY mom DESC, asset) AS rk FROM f WHERE mom IS NOT NULL),
      t AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, list(asset) FILTER (WHERE rk <= 3) AS enter, list(asset) FILTER (WHERE rk <= 6) AS hold FROM rk GROUP BY ts),
      st(i, m) AS (SELECT i, list_sort(enter) FROM t WHERE i = 1 UNION ALL SELECT t.i, list_sort(list_distinct(list_concat(list_intersect(st.m, t.hold), t.enter))) FROM st JOIN t ON t.i = st.i + 1)
      SELECT rk.ts, rk.asset, list_contains(st.m, rk.asset) AS member FROM rk JOIN t ON rk.ts = t.ts JOIN st ON st.i = t.i"""),
    "residual_multi": (residual_multi, rounding(FEATURES + """, g AS (SELECT asset, ts, mom AS y, size, volume, count(*) OVER (PARTITION BY ts) AS n FROM f WHERE mom IS NOT NULL AND size IS NOT NULL AND volume IS NOT NULL),
      u AS (SELECT asset, ts, n, y - avg(y) OVER t AS y, (size - avg(size) OVER t) / nullif(stddev_samp(size) OVER t, 0) AS a, (volume - avg(volume) OVER t) / nullif(stddev_samp(volume) OVER t, 0) AS b FROM g WHERE n >= 8 WINDOW t AS (PARTITION BY ts)),
      m AS (SELECT *, sum(a * a) OVER t AS aa, sum(b * b) OVER t AS bb, sum(a * b) OVER t AS ab, sum(a * y) OVER t AS ay, sum(b * y) OVER t AS sy FROM u WINDOW t AS (PARTITION BY ts)),
      o AS (SELECT asset, ts, y - a * (bb * ay - ab * sy) / (aa * bb - ab * ab) - b * (aa * sy - ab * ay) / (aa * bb - ab * ab) AS res FROM m), z AS (SELECT f.asset, f.ts, res FROM f LEFT JOIN o USING (asset, ts))""", "res", "asset, ts", 5)),
}
