"""Queries over rules, combinations, composed replications and audits."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import change, lag
from ..operators import crosssection as xs
from ..operators import evidence, grid, inference, strategy, timeseries
from ..operators import portfolio as pf
from .inference_queries import PATHS, _nw_sql, paths
from .panels import EVENT_HOURS, NATION_DAY, NATION_MONTH, ema_cte, event_grid, nation_day, nation_month, rounded, rounding
from .portfolio_queries import DAY, FEATURES, _avg_rank_sql, features, segment_sql

W = "PARTITION BY asset ORDER BY ts"
#: Paths whose P&L correlates more than this count as the same.
ALIKE = 0.5
RUN = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    p = event_grid(spark, sf)
    return p.withColumns({c: grid.fill_forward(c) for c in ("open", "high", "low", "close")}).withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def rule_library(spark: SparkSession, sf: str) -> DataFrame:
    """All 29 rules on every event type, by metric; funding is a fiftieth of the change over eight rows."""
    d = strategy.indicators(_filled(spark, sf)).withColumn("rate", change("close", 8) / 50)
    d = strategy.funding_features(d, "rate", 240, 80).withColumn("noise", strategy.noise())
    return rounded(strategy.position_metrics(strategy.evaluate_rules(d, strategy.rules(funding=True)), 8760))


def _rank_sql(x: str) -> str:
    return f"(len(list_filter(l_{x}, lambda v: v < {x})) + (len(list_filter(l_{x}, lambda v: v = {x})) + 1) / 2.0::DOUBLE) / len(list_filter(l_{x}, lambda v: v IS NOT NULL))"


def _rule_sql() -> str:
    roll = lambda f, x, k, least=None: f"CASE WHEN count({x}) OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) >= {least or k} THEN {f.format(x)} OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END"
    last = lambda x: f"last_value({x} IGNORE NULLS) {RUN}"
    made = " UNION ALL ".join(f"SELECT '{n}' AS rule, asset, ts, r, CASE WHEN {up} THEN 1.0::DOUBLE WHEN {down} THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM i7" for n, (up, down) in (strategy.RULES | strategy.FUNDING_RULES).items())
    means = ", ".join(f"CASE WHEN count(close) {RUN} >= {n} THEN e{n} END AS ema{n}" for n in (20, 50, 100, 200))
    return "RECURSIVE " + EVENT_HOURS.strip() + f""", q AS (SELECT asset, ts, {last("close")} AS close, {last("high")} AS high, {last("low")} AS low, coalesce(volume, 0) AS volume FROM p),
  i0 AS (SELECT *, lag(close) OVER ({W}) AS pc FROM q), i1 AS (SELECT *, CASE WHEN high IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, greatest(close - pc, 0) AS g0, greatest(pc - close, 0) AS s0, close * volume AS pv FROM i0),
  i1b AS (SELECT * REPLACE (CASE WHEN pc IS NOT NULL THEN g0 END AS g0, CASE WHEN pc IS NOT NULL THEN s0 END AS s0) FROM i1),
  {ema_cte("em", "i1b", {"e20": ("close", 20), "e50": ("close", 50), "e100": ("close", 100), "e200": ("close", 200), "gain": ("g0", 27), "loss": ("s0", 27)})},
  i2 AS (SELECT b.*, {means}, CASE WHEN count(g0) {RUN} >= 14 AND loss <> 0 THEN 100 - 100 / (1 + gain / loss) END AS rsi14 FROM i1b b JOIN em USING (asset, ts)),
  i3 AS (SELECT *, {roll("avg({})", "tr", 14)} / nullif(close, 0) AS atr_pct, {roll("sum({})", "pv", 72)} / nullif({roll("sum({})", "volume", 72)}, 0) AS vwap72, {roll("sum({})", "pv", 168)} / nullif({roll("sum({})", "volume", 168)}, 0) AS vwap168,
    {roll("avg({})", "close", 20)} AS mid, 2 * ({roll("stddev_samp({})", "close", 20)}) AS width, {roll("max({})", "close", 72)} AS top, {roll("min({})", "close", 72)} AS bottom, close / nullif(lag(close, 20) OVER ({W}), 0) - 1 AS ret20, close / nullif(lag(close, 24) OVER ({W}), 0) - 1 AS ret24,
    {roll("avg({})", "close", 50)} AS mean50, (close / nullif(lag(close, 8) OVER ({W}), 0) - 1) / 50 AS rate, close / nullif(pc, 0) - 1 AS r, list(ema20) OVER ({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS l_ema20, list(volume) OVER ({W} ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS l_volume FROM i2),
  i4 AS (SELECT *, {roll("quantile_cont({}, 0.5)", "atr_pct", 120, 60)} AS atr_median, mid + width AS band_high, mid - width AS band_low, lag(top) OVER ({W}) AS high72, lag(bottom) OVER ({W}) AS low72, lag(ema100, 24) OVER ({W}) AS ema100_24, lag(ema200, 24) OVER ({W}) AS ema200_24,
    CASE WHEN ema20 IS NOT NULL AND len(list_filter(l_ema20, lambda v: v IS NOT NULL)) >= 60 THEN {_rank_sql("ema20")} END AS ema20_rank, CASE WHEN len(l_volume) >= 60 THEN {_rank_sql("volume")} END AS volume_rank, {last("rate")} AS filled, md5(asset || '|' || strftime(ts, '%Y%m%d%H')) AS noise FROM i3),
  i5 AS (SELECT *, lag(filled) OVER ({W}) AS funding FROM i4), i6 AS (SELECT *, (funding - ({roll("avg({})", "funding", 240, 80)})) / nullif({roll("stddev_samp({})", "funding", 240, 80)}, 0) AS fz FROM i5),
  i7 AS (SELECT *, CASE WHEN fz IS NOT NULL THEN greatest(-5, least(5, fz)) END AS funding_z FROM i6),
  pm AS ({made}), """


def position_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Momentum and reversal over 3 rows, on months of nations."""
    p = nation_month(spark, sf)
    made = {"momentum_3": F.coalesce(F.signum(change("close", 3)), F.lit(0.0)), "reversal_3": F.coalesce(-F.signum(change("close", 3)), F.lit(0.0))}
    return rounded(strategy.position_metrics(strategy.evaluate_rules(p, made), 12))


def path_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(strategy.uncorrelated(paths(spark, sf), 0.2))


def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(strategy.walk_forward(paths(spark, sf), 5, 12))


def blend_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best blends of up to three of six nations' paths: the best by Sharpe that are little like those before."""
    p = paths(spark, sf)
    scores = [(r.path, r.s) for r in p.groupBy("path").agg(pf.sharpe("r", 12).alias("s")).collect()]  # a row a nation
    alike = {(r.a, r.b): r["corr"] for r in strategy.correlations(p).where(F.abs("corr") > ALIKE).collect()}  # at most all pairs of nations
    members = strategy.greedy_pool(spark, scores, alike, ALIKE, 6)
    return rounded(strategy.blends(p, members, 5, 12).orderBy(F.desc("sharpe"), "blend").limit(20))


def ridge_combine(spark: SparkSession, sf: str) -> DataFrame:
    f = features(spark, sf).withColumn("size2", F.col("volume"))
    w = strategy.ridge(f, "fwd", ["mom", "size2"], 1.0)
    return rounded(spark.createDataFrame(list(w.items()), "signal string, weight double"))


def monthly_execution(spark: SparkSession, sf: str) -> DataFrame:
    """Month-end rank weights held for a month, a day late."""
    d = nation_day(spark, sf).withColumn("close", grid.fill_forward("close")).withColumn("mom", change("close", 20))
    ends = pf.rank_weights(d, "mom", 5, "w").where(F.last_day("ts") == F.to_date("ts")).select("asset", "ts", "w")
    return rounded(strategy.monthly_targets(d.select("asset", "ts"), ends, "w").select("asset", "ts", "w"), 8)


def momentum_replication(spark: SparkSession, sf: str) -> DataFrame:
    """Monday momentum, value-weighted outer tertiles, two-row lag, daily P&L by split with its robust t."""
    d = nation_day(spark, sf).withColumn("close", grid.fill_forward("close")).withColumn("r", change("close")).withColumn("mom", change("close", 20)).withColumn("cap", F.coalesce(grid.fill_forward("vol_quote"), F.lit(0.0)))
    formed = pf.segment_weights(d, "mom", "cap", 0.3, 5, "w").where(F.dayofweek("ts") == 2).select("asset", "ts", "w")
    live = pf.execute_formations(d.select("asset", "ts", "r"), formed, "w", 2, 7)
    path = pf.pnl(live.join(grid.splits(live).select("ts", "split"), "ts"), "w", "r", part=("split",))
    return rounded(inference.newey_west(path, "net", 4, ["split"]), 6)


def liquidity_momentum(spark: SparkSession, sf: str) -> DataFrame:
    """The day's return of the ten largest and of the ten most liquid nations, outer fifths a day late, equal and value weighted.

    Robust t of the daily IC and of the daily P&L by segment, weighting and split.
    """
    d = nation_day(spark, sf).withColumn("close", grid.fill_forward("close")).withColumn("cap", grid.fill_forward("vol_quote"))
    d = evidence.trailing_amihud(d, "close", "cap", 20, 1, "illiquidity").withColumn("r", change("close")).withColumn("signal", F.log("close") - lag(F.log("close")))
    d = d.withColumn("fwd", lag("signal", -1))
    known = F.col("cap").isNotNull()
    masks = {"largest": xs.top_n("cap", known, 10), "liquid": xs.top_n("illiquidity", known, 10, largest=False)}
    parts = []
    for segment, mask in masks.items():
        x = d.withColumn("segment", F.lit(segment)).withColumn("sig", F.when(mask, F.col("signal")))
        parts.append(xs.rank_ic(x, "sig", "fwd", 5, True, ["segment", "ts"]).select("ts", "segment", F.lit("none").alias("weighting"), F.lit("ic").alias("measure"), F.col("ic").alias("x")))
        for weighting in ("equal", "value"):
            w = pf.segment_weights(x, "sig", "cap", 0.2, 5, "w", equal=weighting == "equal", apart=True).withColumn("h", pf.held("w"))
            path = pf.pnl(w.join(grid.splits(w).select("ts", "split"), "ts"), "h", "r", part=("split",))
            parts.append(path.select("ts", F.lit(segment).alias("segment"), F.lit(weighting).alias("weighting"), F.lit("net").alias("measure"), F.col("net").alias("x")))
    rows = reduce(DataFrame.unionByName, parts).join(grid.splits(d).select("ts", "split"), "ts")
    return rounded(inference.newey_west(rows, "x", 4, ["measure", "segment", "weighting", "split"]))


def low_vol_replication(spark: SparkSession, sf: str) -> DataFrame:
    """Low volatility: next-month IC and its robust t in halves of the months."""
    p = nation_month(spark, sf).withColumn("r", change("close"))
    p = p.withColumn("signal", -F.when(F.count("r").over(Window.partitionBy("asset").orderBy("ts").rowsBetween(-11, 0)) >= 9, F.stddev_samp("r").over(Window.partitionBy("asset").orderBy("ts").rowsBetween(-11, 0))))
    ic = xs.rank_ic(p.withColumn("fwd", lag("r", -1)), "signal", "fwd", 5, True).join(grid.splits(p), "ts")
    return rounded(inference.newey_west(ic, "ic", 3, ["split"]))


def ic_inference(spark: SparkSession, sf: str) -> DataFrame:
    """Count, mean, share of positive ICs and plain t by split."""
    f = features(spark, sf)
    ic = xs.rank_ic(f, "mom", "fwd", 5, False).join(grid.splits(f), "ts")
    return rounded(ic.groupBy("split").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"), inference.mean_t("ic").alias("t")))


def empirical_block_null(spark: SparkSession, sf: str) -> DataFrame:
    """The observed block t of monthly ICs against draws of an autocorrelated null."""
    f = features(spark, sf)
    obs = inference.block_t(xs.rank_ic(f, "mom", "fwd", 5, False).withColumn("k", F.lit("ic")), "ic", 7, ["k"]).first()
    blocks, assets = int(obs.n_blocks), 25

    def draw(seed: int) -> dict:
        rng = np.random.default_rng([99991, seed])
        x = inference.ar1(rng, blocks * 7, 0.25, 1 / np.sqrt(assets - 1)).reshape(blocks, 7).mean(axis=1)
        return {"t": float(x.mean() / (x.std(ddof=1) / np.sqrt(blocks)))}

    d = inference.seeded_draws(spark, 2000, "t double", draw)
    return d.agg(F.lit(float(obs.t)).alias("t"), ((F.count_if(F.col("t") >= float(obs.t)) + 1) / (F.count(F.lit(1)) + 1)).alias("p"), F.percentile("t", F.lit(0.9)).alias("watch"), F.count(F.lit(1)).alias("draws"))


def gate_status(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on each nation's path from split metrics, with the failed checks."""
    from ..operators import audit

    p = paths(spark, sf)
    m = p.join(grid.splits(p), "ts").groupBy("path").pivot("split", ["is", "val", "holdout"]).agg(pf.sharpe("r", 12).alias("sharpe"), F.sum("r").alias("total"))
    checks = {"val_sharpe": (F.col("val_sharpe") > 0) & (F.col("val_total") > 0), "is_sharpe": F.col("is_sharpe") > -0.5, "holdout_sharpe": F.col("holdout_sharpe") > -0.25}
    return m.select("path", *audit.status(checks))


def shadow_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days observed, span and coverage of each event type, and whether the last is fresh."""
    from .panels import table

    d = table(spark, sf, "events").select(F.col("event_type").alias("track"), F.to_date("ts").alias("day")).distinct()
    last = F.max("day").over(Window.partitionBy(F.lit(0)))
    d = d.withColumn("end", last).groupBy("track").agg(F.count(F.lit(1)).alias("days"), (F.datediff(F.max("day"), F.min("day")) + 1).cast("long").alias("span"), F.datediff(F.max("end"), F.max("day")).cast("long").alias("stale"))
    return rounded(d.select("*", (F.col("days") / F.col("span")).alias("coverage"), ((F.col("days") >= 30) & (F.col("stale") <= 1)).alias("ready")))


def drawdown_by_asset(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeseries.drawdown(paths(spark, sf), "r", part=["path"]).select("path", "ts", "cum_pnl", "peak", "drawdown"))


_POS = """pm AS (SELECT rule, asset, ts, r, p FROM (SELECT 'momentum_3' AS rule, *, coalesce(sign(mom), 0) AS p FROM f UNION ALL SELECT 'reversal_3', *, coalesce(-sign(mom), 0) FROM f)),
  h AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY rule, asset ORDER BY ts), 0) AS held FROM pm),
  c AS (SELECT *, coalesce(held * r, 0) - abs(held - coalesce(lag(held) OVER (PARTITION BY rule, asset ORDER BY ts), 0)) * 7 / 10000 AS pnl, held <> coalesce(lag(held) OVER (PARTITION BY rule, asset ORDER BY ts), 0) AND held <> 0 AS nw FROM h),
  d AS (SELECT *, sum(pnl) OVER (PARTITION BY rule, asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM c),
  e AS (SELECT *, max(cum) OVER (PARTITION BY rule, asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cum AS dd FROM d),
  z AS (SELECT rule, asset, count(*) AS n, sum(pnl) AS total, avg(pnl) / stddev_samp(pnl) * sqrt(12.0::DOUBLE) AS sharpe, max(dd) AS max_drawdown, avg(abs(held)) AS exposure, avg(CASE WHEN held > 0 THEN 1.0::DOUBLE ELSE 0 END) AS long_share, count(*) FILTER (WHERE nw) AS trades,
    sum(CASE WHEN pnl > 0 THEN pnl END) / sum(CASE WHEN pnl < 0 THEN -pnl END) AS profit_factor, max(pnl) AS best, min(pnl) AS worst FROM e GROUP BY ALL)"""
_SPLITS = """t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM {src})),
  s AS (SELECT ts, CASE WHEN pos < floor(n * 0.5::DOUBLE) THEN 'is' WHEN pos < floor(n * 0.5::DOUBLE) + floor(n * 0.17::DOUBLE) THEN 'val' ELSE 'holdout' END AS split FROM t)"""
_MOMENTUM = NATION_DAY + ", " + _SPLITS.format(src="p") + f""", q AS (SELECT asset, ts, last_value(close IGNORE NULLS) {RUN} AS close, coalesce(last_value(vol_quote IGNORE NULLS) {RUN}, 0) AS cap FROM p),
  f AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r, close / lag(close, 20) OVER ({W}) - 1 AS mom FROM q), a AS (SELECT *, CASE WHEN cap > 0 THEN mom END AS x FROM f),
  {segment_sql("a", "x", "cap", 0.3)}, d AS (SELECT asset, ts, r, CASE WHEN dayofweek(ts) = 1 THEN w END AS w, row_number() OVER ({W}) AS i FROM sw),
  l AS (SELECT *, last_value(CASE WHEN w IS NOT NULL THEN i END IGNORE NULLS) {RUN} AS li, last_value(w IGNORE NULLS) {RUN} AS lw FROM d),
  h AS (SELECT asset, l.ts, r, split, coalesce(CASE WHEN i - 2 - lag(li, 2) OVER (PARTITION BY asset ORDER BY l.ts) < 7 THEN lag(lw, 2) OVER (PARTITION BY asset ORDER BY l.ts) END, 0) AS h FROM l JOIN s ON l.ts = s.ts),
  e AS (SELECT *, abs(h - coalesce(lag(h) OVER (PARTITION BY asset, split ORDER BY ts), 0)) AS tn FROM h),
  path AS (SELECT split, ts, coalesce(sum(h * r), 0) - sum(tn) * 7 / 10000 AS net FROM e GROUP BY split, ts)"""
_LIQUIDITY = NATION_DAY + ", " + _SPLITS.format(src="p") + f""", q AS (SELECT asset, ts, last_value(close IGNORE NULLS) {RUN} AS close, last_value(vol_quote IGNORE NULLS) {RUN} AS cap FROM p),
  q1 AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r, ln(close) - lag(ln(close)) OVER ({W}) AS signal FROM q), q2 AS (SELECT *, lag(abs(signal) / cap) OVER ({W}) AS i1, lead(signal) OVER ({W}) AS fwd FROM q1),
  q3 AS (SELECT *, CASE WHEN count(i1) OVER v >= 20 THEN avg(i1) OVER v END AS il FROM q2 WINDOW v AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  g AS (SELECT 'largest' AS segment, *, CASE WHEN cap IS NOT NULL AND row_number() OVER (PARTITION BY ts ORDER BY cap DESC NULLS LAST, asset) <= 10 THEN signal END AS x FROM q3
    UNION ALL SELECT 'liquid', *, CASE WHEN cap IS NOT NULL AND il IS NOT NULL AND row_number() OVER (PARTITION BY ts ORDER BY CASE WHEN cap IS NOT NULL THEN il END NULLS LAST, asset) <= 10 THEN signal END FROM q3),
  g2 AS (SELECT weighting, g.*, CASE WHEN weighting = 'equal' THEN 1 ELSE cap END AS cp FROM g CROSS JOIN (SELECT unnest(['equal', 'value']) AS weighting)), {segment_sql("g2", "x", "cp", 0.2, "segment, weighting, ts", apart=True)},
  w AS (SELECT segment, weighting, asset, sw.ts, r, split, w FROM sw JOIN s ON sw.ts = s.ts),
  h AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY segment, weighting, asset ORDER BY ts), 0) AS h FROM w), e AS (SELECT *, abs(h - coalesce(lag(h) OVER (PARTITION BY segment, weighting, asset, split ORDER BY ts), 0)) AS tn FROM h),
  y AS (SELECT segment, ts, rank() OVER (PARTITION BY segment, ts ORDER BY x) + (count(*) OVER (PARTITION BY segment, ts, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY segment, ts ORDER BY fwd) + (count(*) OVER (PARTITION BY segment, ts, fwd) - 1) / 2.0::DOUBLE AS ry FROM g WHERE x IS NOT NULL AND fwd IS NOT NULL),
  ic AS (SELECT segment, ts, CASE WHEN count(*) >= 5 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS ic FROM y GROUP BY ALL),
  path AS (SELECT 'net' AS measure, segment, weighting, split, ts, coalesce(sum(h * r), 0) - sum(tn) * 7 / 10000 AS x FROM e GROUP BY ALL UNION ALL SELECT 'ic', segment, 'none', split, ic.ts, ic FROM ic JOIN s ON ic.ts = s.ts)"""
_BLENDS = PATHS + f""", sc AS (SELECT path, coalesce(avg(r) / nullif(stddev_samp(r), 0), 0) AS s FROM path GROUP BY path), cr AS (SELECT x.path AS a, y.path AS b FROM path x JOIN path y ON x.ts = y.ts AND x.path <> y.path GROUP BY ALL HAVING stddev_pop(x.r) > 0 AND stddev_pop(y.r) > 0 AND abs(corr(x.r, y.r)) > {ALIKE}),
  o AS (SELECT path, row_number() OVER (ORDER BY s DESC, path) AS i, coalesce((SELECT list(b) FROM cr WHERE cr.a = sc.path), []) AS alike FROM sc),
  g(i, pool) AS (SELECT i, [path] FROM o WHERE i = 1 UNION ALL SELECT o.i, CASE WHEN len(pool) < 6 AND NOT list_has_any(o.alike, pool) THEN list_append(pool, o.path) ELSE pool END FROM g JOIN o ON o.i = g.i + 1),
  mb AS (SELECT unnest(pool) AS path, generate_subscripts(pool, 1) AS k FROM g WHERE i = (SELECT max(i) FROM o)), u AS (SELECT a.k AS k1, b.k AS k2, c.k AS k3, ua, ub, uc FROM mb a, mb b, mb c, range(1, 6) x(ua), range(0, 5) y(ub), range(0, 5) v(uc) WHERE ua + ub + uc = 5 AND ((ub = 0 AND uc = 0 AND b.k = 1 AND c.k = 1) OR (ub > 0 AND uc = 0 AND a.k < b.k AND c.k = 1) OR (ub > 0 AND uc > 0 AND a.k < b.k AND b.k < c.k))),
  lb AS (SELECT k, ts, path, r FROM mb JOIN path USING (path)), nm AS (SELECT i AS units, CASE WHEN i = 5 THEN '1' ELSE '0.' || (2 * i) END AS label FROM range(1, 6) t(i)),
  bl AS (SELECT a.path || ':' || na.label || CASE WHEN ub > 0 THEN '+' || b.path || ':' || nb.label ELSE '' END || CASE WHEN uc > 0 THEN '+' || c.path || ':' || nc.label ELSE '' END AS blend, CAST(1 + (ub > 0)::INT + (uc > 0)::INT AS INT) AS members, (ua * a.r + ub * b.r + uc * c.r) / 5.0::DOUBLE AS r
    FROM u JOIN lb a ON a.k = k1 JOIN lb b ON b.k = k2 AND b.ts = a.ts JOIN lb c ON c.k = k3 AND c.ts = a.ts JOIN nm na ON na.units = ua LEFT JOIN nm nb ON nb.units = ub LEFT JOIN nm nc ON nc.units = uc),
  z AS (SELECT blend, members, CASE WHEN var_samp(r) > 1e-18 THEN avg(r) / stddev_samp(r) * sqrt(12.0::DOUBLE) ELSE 0 END AS sharpe FROM bl GROUP BY ALL ORDER BY sharpe DESC, blend LIMIT 20)"""
QUERIES = {
    "rule_library": (rule_library, rounding(_rule_sql() + _POS[_POS.index("h AS (") :].replace("sqrt(12.0::DOUBLE)", "sqrt(8760.0::DOUBLE)").replace("avg(pnl) / stddev_samp(pnl) * sqrt(8760.0::DOUBLE)", "coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(8760.0::DOUBLE), 0)"), "total, sharpe, max_drawdown, exposure, long_share, profit_factor, best, worst", "rule, asset, n, trades")),
    "position_backtest": (position_backtest, rounding(FEATURES + ", " + _POS, "total, sharpe, max_drawdown, exposure, long_share, profit_factor, best, worst", "rule, asset, n, trades")),
    "path_correlations": (path_correlations, rounding(PATHS + ", z AS (SELECT * FROM (SELECT x.path AS a, y.path AS b, corr(x.r, y.r) AS corr FROM path x JOIN path y ON x.ts = y.ts AND x.path < y.path GROUP BY ALL) WHERE abs(corr) <= 0.2)", "corr", "a, b")),
    "walk_forward": (walk_forward, rounding(PATHS + ", sg AS (SELECT ts, ntile(5) OVER (ORDER BY ts) AS part FROM (SELECT DISTINCT ts FROM path)), z AS (SELECT path, part, avg(r) / stddev_samp(r) * sqrt(12.0::DOUBLE) AS sharpe, sum(r) AS total, count(*) AS n FROM path JOIN sg USING (ts) GROUP BY ALL)", "sharpe, total", "path, part, n")),
    "blend_grid": (blend_grid, rounding("RECURSIVE " + _BLENDS, "sharpe", "blend, members")),
    "ridge_combine": (ridge_combine, rounding(FEATURES + """, d AS (SELECT fwd, mom AS a, volume AS b FROM f WHERE fwd IS NOT NULL AND mom IS NOT NULL AND volume IS NOT NULL),
      st AS (SELECT fwd, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b FROM d),
      m AS (SELECT sum(a * a) + 1 AS aa, sum(b * b) + 1 AS bb, sum(a * b) AS ab, sum(a * fwd) AS ay, sum(b * fwd) AS byy FROM st),
      z AS (SELECT 'mom' AS signal, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS weight FROM m UNION ALL SELECT 'size2', (aa * byy - ab * ay) / (aa * bb - ab * ab) FROM m)""", "weight", "signal")),
    "monthly_execution": (monthly_execution, rounding(DAY + f""", a AS (SELECT *, CASE WHEN count(mom) OVER (PARTITION BY ts) >= 5 THEN ({_avg_rank_sql("mom")}) / count(mom) OVER (PARTITION BY ts) - 0.5::DOUBLE END AS p0 FROM f), b AS (SELECT *, p0 - avg(p0) OVER (PARTITION BY ts) AS p1 FROM a),
      rw AS (SELECT *, coalesce(p1 / nullif(sum(abs(p1)) OVER (PARTITION BY ts), 0), 0) AS w0 FROM b), l AS (SELECT asset, ts, last_value(CASE WHEN last_day(ts) = ts::DATE THEN w0 END IGNORE NULLS) {RUN} AS lv FROM rw),
      z AS (SELECT asset, ts, coalesce(lag(lv) OVER ({W}), 0) AS w FROM l)""", "w", "asset, ts", 8)),
    "momentum_replication": (momentum_replication, rounding(_MOMENTUM + ", " + _nw_sql("path", "split", "net", 4), "mean, se, t", "split, n")),
    "liquidity_momentum": (liquidity_momentum, rounding(_LIQUIDITY + ", " + _nw_sql("path", "measure, segment, weighting, split", "x", 4), "mean, se, t", "measure, segment, weighting, split, n")),
    "low_vol_replication": (low_vol_replication, rounding(NATION_MONTH + ", " + _SPLITS.format(src="p") + f""", a AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r FROM p), b AS (SELECT *, -CASE WHEN count(r) OVER v >= 9 THEN stddev_samp(r) OVER v END AS signal, lead(r) OVER ({W}) AS fwd FROM a WINDOW v AS ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
      y AS (SELECT ts, {_avg_rank_sql("signal")} AS rx, {_avg_rank_sql("fwd")} AS ry FROM b WHERE signal IS NOT NULL AND fwd IS NOT NULL), i AS (SELECT ts, CASE WHEN count(*) >= 5 THEN corr(rx, ry) END AS ic FROM y GROUP BY ts), q AS (SELECT split, ts, ic FROM i JOIN s USING (ts)), """ + _nw_sql("q", "split", "ic", 3), "mean, se, t", "split, n")),
    "ic_inference": (ic_inference, rounding(FEATURES + ", " + _SPLITS.format(src="f") + f""", a AS (SELECT ts, {_avg_rank_sql("mom")} AS x, {_avg_rank_sql("fwd")} AS y FROM f),
      g AS (SELECT ts, CASE WHEN count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) >= 5 THEN corr(x, y) END AS ic FROM a GROUP BY ts),
      z AS (SELECT split, count(ic) AS n, avg(ic) AS mean, avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE WHEN ic IS NOT NULL THEN 0 END) AS positive, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t FROM g JOIN s USING (ts) GROUP BY split)""", "mean, positive, t", "split, n")),
    "empirical_block_null": (empirical_block_null, None),
    "gate_status": (gate_status, "WITH " + PATHS.strip() + ", " + _SPLITS.format(src="path") + """, m AS (SELECT path, split, avg(r) / stddev_samp(r) * sqrt(12.0::DOUBLE) AS sr, sum(r) AS tot FROM path JOIN s USING (ts) GROUP BY ALL),
      w AS (SELECT path, max(CASE WHEN split = 'val' THEN sr END) AS v, max(CASE WHEN split = 'val' THEN tot END) AS vt, max(CASE WHEN split = 'is' THEN sr END) AS i, max(CASE WHEN split = 'holdout' THEN sr END) AS h FROM m GROUP BY path),
      b AS (SELECT path, list_filter([CASE WHEN v > 0 AND vt > 0 THEN NULL ELSE 'val_sharpe' END, CASE WHEN i > -0.5 THEN NULL ELSE 'is_sharpe' END, CASE WHEN h > -0.25 THEN NULL ELSE 'holdout_sharpe' END], lambda x: x IS NOT NULL) AS b FROM w)
      SELECT path, CASE WHEN len(b) = 0 THEN 'pass' ELSE 'reject' END AS status, array_to_string(b, ',') AS failed_checks FROM b"""),
    "shadow_days": (shadow_days, rounding("""d AS (SELECT DISTINCT event_type AS track, ts::DATE AS day FROM events), g AS (SELECT track, count(*) AS days, max(day) - min(day) + 1 AS span, (SELECT max(day) FROM d) - max(day) AS stale FROM d GROUP BY track), z AS (SELECT *, days / span::DOUBLE AS coverage, days >= 30 AND stale <= 1 AS ready FROM g)""", "coverage", "track, days, span, stale, ready")),
    "drawdown_by_asset": (drawdown_by_asset, rounding(PATHS + """, c AS (SELECT path, ts, sum(r) OVER (PARTITION BY path ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pnl FROM path), k AS (SELECT *, max(cum_pnl) OVER (PARTITION BY path ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM c), z AS (SELECT *, peak - cum_pnl AS drawdown FROM k)""", "cum_pnl, peak, drawdown", "path, ts")),
}
