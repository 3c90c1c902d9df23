"""Queries over one asset's series: bars, returns, rolling features, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dsl
from ..functions.numeric import asset_time, change, clip, div, forward, lag, rolling, trailing
from ..operators import grid
from ..operators import timeseries as ts
from .panels import EVENT_DAYS, EVENT_HOURS, NATION_DAY, NATION_MONTH, SUPPLIER_MONTH, event_days, event_grid, event_hours, nation_day, nation_month, rounded, rounding, supplier_month, table

W = "PARTITION BY asset ORDER BY ts"


def _roll(agg: str, x: str, k: int, least: int | None = None) -> str:
    """SQL of a rolling aggregate with a least count; ``x`` stands for {} in ``agg``."""
    over = f"OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {least or k} THEN {agg.format(x)} {over} END"


def panel_bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(event_hours(spark, sf))


def bars_daily_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars to days; a day with fewer than 24 hours is NULL."""
    h = event_hours(spark, sf).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    full = F.count(F.lit(1)) >= 24
    agg = {"open": F.min_by("open", "ts"), "high": F.max("high"), "low": F.min("low"), "close": F.max_by("close", "ts"), "volume": F.sum("volume")}
    return rounded(h.groupBy("asset", F.col("day").alias("ts")).agg(F.count(F.lit(1)).alias("n_bars"), *[F.when(full, a).alias(c) for c, a in agg.items()]))


def panel_dense_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(nation_month(spark, sf))


def bar_spacing(spark: SparkSession, sf: str) -> DataFrame:
    """Median hours between an asset's bars."""
    gap = (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(asset_time()).cast("timestamp"))) / 3600
    d = event_hours(spark, sf).withColumn("gap", gap)
    return rounded(d.groupBy("asset").agg(F.percentile("gap", F.lit(0.5)).alias("median_hours"), F.max("gap").alias("longest_hours"), F.count("gap").alias("n")))


def returns_momentum(spark: SparkSession, sf: str) -> DataFrame:
    p = nation_month(spark, sf)
    return rounded(p.select("asset", "ts", change("close").alias("returns"), change("close", 3).alias("momentum_3"), (-change("close")).alias("reversal_1"), lag("close", 2).alias("delayed")))


def forward_returns_purged(spark: SparkSession, sf: str) -> DataFrame:
    p = nation_month(spark, sf)
    out = grid.purged_forward(p, grid.splits(p), "close", 3, "fwd")
    return rounded(out.select("asset", "ts", F.col("pos").cast("long").alias("pos"), "split", "fwd"))


def rolling_vol_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    p = nation_month(spark, sf).withColumn("r", change("close"))
    p = p.withColumn("realized_vol", rolling(F.stddev_samp, "r", 12, 6)).withColumn("liquidity_size", ts.liquidity(12, 6))
    p = p.withColumn("liquidity_change", F.col("liquidity_size") - lag("liquidity_size", 3)).withColumn("amihud", ts.amihud("r", 12, 6) * 1e6)
    return rounded(p.select("asset", "ts", "realized_vol", "liquidity_size", "liquidity_change", "amihud", div(change("close", 3), "realized_vol").alias("vol_managed")))


def volume_shock(spark: SparkSession, sf: str) -> DataFrame:
    p = nation_day(spark, sf)
    p = p.withColumn("a", rolling(F.sum, "volume", 7, 3)).withColumn("b", rolling(F.avg, "volume", 60, 30))
    return rounded(p.select("asset", "ts", div("a", "b").alias("volume_shock")))


def zscore_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Long z-scores from running sums, lagged and clipped to five deviations."""
    p = ts.long_moments(nation_day(spark, sf), "close", 120, "m", "s", 40)
    p = p.withColumn("z", clip(div(F.col("close") - F.col("m"), F.when(F.col("s") > 1e-9, F.col("s"))), -5, 5))
    # Sums of decimals are exact in any order, so the mean has all its digits.
    exact = rolling(F.sum, F.col("close").cast("decimal(28,8)"), 120, 40).cast("double")
    p = p.withColumn("mean_120", exact / F.count("close").over(trailing(120)))
    return p.select("asset", "ts", F.round("z", 4).alias("z"), F.round(lag("z"), 4).alias("z_lag"), F.round("mean_120", 6).alias("mean_120"))


def carry_features(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse carry filled for 3 rows, its lag, persistence and a capped change crossed with momentum."""
    p = nation_day(spark, sf).withColumn("rate", F.when(F.col("volume") >= 2, F.col("close") / 1e6))
    p = p.withColumn("signal", grid.fill_forward("rate", 3)).withColumn("oi", clip(change("vol_quote", 5), -1, 3))
    p = p.withColumn("carry", lag("signal")).withColumn("persistence", rolling(F.avg, "signal", 20, 8)).withColumn("mom", change("close", 5))
    p = p.withColumn("persistence", lag("persistence")).withColumn("crowding", F.lit(0.0) - F.col("mom") * clip("oi", low=0))
    p = p.withColumn("trend_carry", F.col("mom") - clip("carry", low=0))
    return rounded(p.select("asset", "ts", "signal", "carry", "persistence", "oi", "crowding", "trend_carry"))


DSL_PACK = {
    "ret3": "returns(close, 3)", "logret": "log_returns(high, 1)", "d2": "diff(close, 2)", "sma12": "sma(close, 12)", "mean5": "ts_mean(volume, 5)", "std12": "std(close, 12)",
    "med12": "quantile(close, 12, 0.5)", "z12": "zscore(close, 12)", "bw": "bb_bw(close, 12, 2)", "pctb": "bb_pctb(close, 12, 2)", "mx": "ts_max(high, 6)", "mn": "ts_min(low, 6)",
    "dl": "ts_delay(close, 2)", "mix": "div(add(close, open), sub(high, neg(low)))", "hi": "max(open, close)", "lo": "min(open, close)", "ab": "abs(mul(close, -1))", "sel": "if(gt(close, open), high, low)", "flag": "lt(close, open)",
}


def dsl_rolling_pack(spark: SparkSession, sf: str) -> DataFrame:
    out = dsl.evaluate(event_grid(spark, sf), DSL_PACK)
    return rounded(out.select("asset", "ts", *DSL_PACK), 5)


def ts_rank_window(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dsl.evaluate(event_grid(spark, sf), {"rank12": "ts_rank(close, 12)"}).select("asset", "ts", "rank12"))


def ts_corr_window(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dsl.evaluate(event_grid(spark, sf), {"corr24": "ts_corr(close, volume, 24)"}).select("asset", "ts", "corr24"))


def ffill_limited(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(nation_day(spark, sf).select("asset", "ts", grid.fill_forward("close", 2).alias("filled"), grid.fill_forward("close").alias("filled_any")))


def lag_daily_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Daily sums on the hourly grid, known a day later and stale after a day."""
    daily = event_days(spark, sf).select("asset", "ts", "vol_quote")
    out = grid.lagged_events(event_grid(spark, sf).select("asset", "ts"), daily, "vol_quote", 1, 24, "known")
    return rounded(out.select("asset", "ts", "known"))


def asof_unbounded(spark: SparkSession, sf: str) -> DataFrame:
    """Each click with the last purchase value of the same user at or before it."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("asset"), "ts", "event_id", "event_type", "value")
    first = e.groupBy("event_type").count().select(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    e = e.join(F.broadcast(first), F.col("event_type").isin(F.col("a"), F.col("b")))  # one row
    right = e.where("event_type = b").groupBy("asset", "ts").agg(F.max("value").alias("v"))
    out = grid.asof(e.where("event_type = a").select("asset", "ts", "event_id"), right, "v", "last_value")
    return rounded(out)


def asof_strict(spark: SparkSession, sf: str) -> DataFrame:
    """The same strictly before, as trades meet the preceding quote."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("asset"), "ts", "event_id", "event_type", "value")
    quotes = e.groupBy("asset", "ts").agg(F.max("value").alias("v"))
    return rounded(grid.asof(e.select("asset", "ts", "event_id", "value"), quotes, "v", "mid", strict=True).withColumn("spread_bp", 2e4 * div(F.col("value") - F.col("mid"), "mid")), 4)


def spread_estimators(spark: SparkSession, sf: str) -> DataFrame:
    d = ts.abdi_ranaldo(ts.corwin_schultz(event_days(spark, sf), 6), 6)
    return rounded(d.select("asset", "ts", "cs_spread", "ar_spread", ((F.col("cs_spread") + F.col("ar_spread")) / 2).alias("composite")))


def turnover_volatility(spark: SparkSession, sf: str) -> DataFrame:
    p = nation_month(spark, sf).withColumn("turnover", ts.turnover_ratio("vol_quote", F.col("close") * 500, 0.9))
    return rounded(p.select("asset", "ts", "turnover", rolling(F.stddev_samp, "turnover", 6).alias("turnover_vol")))


def market_beta(spark: SparkSession, sf: str) -> DataFrame:
    p = nation_month(spark, sf).withColumn("r", change("close")).withColumn("was", F.coalesce(lag(F.col("volume") > 5), F.lit(False)))
    p = p.withColumn("market", F.avg(F.when(F.col("was"), F.col("r"))).over(Window.partitionBy("ts")))
    return rounded(ts.rolling_beta(p, "r", "market", 24, 12, "beta").select("asset", "ts", "market", "beta"))


def low_vol_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Negative deviation of log returns at quarter ends, and the return to the next one."""
    p = nation_month(spark, sf).withColumn("lr", F.log(div("close", lag("close"))))
    p = p.withColumn("signal", -rolling(F.stddev_samp, "lr", 12, 9)).where(F.month("ts") % 3 == 0)
    return rounded(p.select("asset", "ts", "signal", forward("close", 1).alias("next_return")))


def observed_history(spark: SparkSession, sf: str) -> DataFrame:
    """Rows seen so far, and the lagged trailing mean turnover of at least 20 rows in 30."""
    p = nation_day(spark, sf)
    run = asset_time().rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("seen", F.count("close").over(run)).withColumn("prev", lag("vol_quote"))
    p = p.withColumn("first", F.min(F.when(F.col("close").isNotNull(), F.col("ts"))).over(Window.partitionBy("asset")))
    age = (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("first").cast("timestamp"))) / 86400
    out = p.withColumn("turnover_30", rolling(F.sum, "prev", 30, 10) / 30).withColumn("age_days", age)
    eligible = F.col("close").isNotNull() & (F.col("age_days") >= 180) & (F.col("seen") >= 60) & F.coalesce(F.col("turnover_30") >= 60000, F.lit(False))
    return rounded(out.select("asset", "ts", "seen", "turnover_30", "age_days", eligible.alias("eligible")), 4)


def position_signal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(nation_month(spark, sf).select("asset", "ts", ts.position("close", 24, 8).alias("pos")))


def update_and_hold(spark: SparkSession, sf: str) -> DataFrame:
    """A daily value that changes only on the first row of a month."""
    p = nation_day(spark, sf).withColumn("m", F.date_trunc("month", "ts"))
    update = F.coalesce(F.col("m") != lag("m"), F.lit(True))
    return rounded(p.withColumn("u", update).select("asset", "ts", ts.hold_to_update(F.coalesce("close", F.lit(0.0)), F.col("u")).alias("held"), "u"))


def long_window_beta(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier months: rolling deviation by running sums over many assets."""
    p = ts.long_moments(supplier_month(spark, sf), "close", 24, "m", "s", 12)
    return rounded(p.select("asset", "ts", "m", "s"), 4)


def _q(fn, sql=None):
    return (fn, sql)


QUERIES = {
    "panel_bars_hourly": _q(panel_bars_hourly, rounding(EVENT_HOURS + ", z AS (SELECT * FROM bars)", "open, high, low, close, volume, vol_quote", "asset, ts")),
    "bars_daily_complete": _q(bars_daily_complete, rounding(EVENT_HOURS + """, z AS (
      SELECT asset, date_trunc('day', ts)::TIMESTAMP AS ts, count(*) AS n_bars, CASE WHEN count(*) >= 24 THEN arg_min(open, ts) END AS open,
        CASE WHEN count(*) >= 24 THEN max(high) END AS high, CASE WHEN count(*) >= 24 THEN min(low) END AS low,
        CASE WHEN count(*) >= 24 THEN arg_max(close, ts) END AS close, CASE WHEN count(*) >= 24 THEN sum(volume) END AS volume
      FROM bars GROUP BY ALL)""".replace("GROUP BY ALL)", "GROUP BY asset, date_trunc('day', ts))"), "open, high, low, close, volume", "asset, ts, n_bars")),
    "panel_dense_grid": _q(panel_dense_grid, rounding(NATION_MONTH + ", z AS (SELECT * FROM p)", "close, volume, vol_quote", "asset, family, ts")),
    "bar_spacing": _q(bar_spacing, rounding(EVENT_HOURS + f""", g AS (SELECT asset, epoch(ts - lag(ts) OVER ({W})) / 3600 AS gap FROM bars),
      z AS (SELECT asset, quantile_cont(gap, 0.5) AS median_hours, max(gap) AS longest_hours, count(gap) AS n FROM g GROUP BY asset)""", "median_hours, longest_hours", "asset, n")),
    "returns_momentum": _q(returns_momentum, rounding(NATION_MONTH + f""", z AS (SELECT asset, ts, close / lag(close) OVER ({W}) - 1 AS returns, close / lag(close, 3) OVER ({W}) - 1 AS momentum_3,
      -(close / lag(close) OVER ({W}) - 1) AS reversal_1, lag(close, 2) OVER ({W}) AS delayed FROM p)""", "returns, momentum_3, reversal_1, delayed", "asset, ts")),
    "forward_returns_purged": _q(forward_returns_purged, rounding(NATION_MONTH + f""", t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM p)),
      s AS (SELECT ts, pos, CASE WHEN pos < floor(n * 0.5::DOUBLE) THEN 'is' WHEN pos < floor(n * 0.5::DOUBLE) + floor(n * 0.17::DOUBLE) THEN 'val' ELSE 'holdout' END AS split FROM t),
      l AS (SELECT split, max(pos) AS last FROM s GROUP BY split),
      f AS (SELECT *, lead(close, 3) OVER ({W}) / close - 1 AS f0 FROM p),
      z AS (SELECT asset, f.ts, pos, s.split, CASE WHEN pos + 3 <= last THEN f0 END AS fwd FROM f JOIN s USING (ts) JOIN l USING (split))""", "fwd", "asset, ts, pos, split")),
    "rolling_vol_liquidity": _q(rolling_vol_liquidity, rounding(NATION_MONTH + f""", a AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r, close / lag(close, 3) OVER ({W}) - 1 AS m3, CASE WHEN vol_quote > 0 THEN vol_quote ELSE close * volume END AS dv FROM p),
      b AS (SELECT *, {_roll("stddev_samp({})", "r", 12, 6)} AS realized_vol, ln({_roll("avg({})", "dv", 12, 6)}) AS liquidity_size, {_roll("sum(abs({}))", "r", 12, 6)} AS sr, {_roll("sum({})", "dv", 12, 6)} AS sv FROM a),
      z AS (SELECT asset, ts, realized_vol, liquidity_size, liquidity_size - lag(liquidity_size, 3) OVER ({W}) AS liquidity_change, sr / sv * 1e6 AS amihud, m3 / realized_vol AS vol_managed FROM b)""", "realized_vol, liquidity_size, liquidity_change, amihud, vol_managed", "asset, ts")),
    "volume_shock": _q(volume_shock, rounding(NATION_DAY + f""", z AS (SELECT asset, ts, ({_roll("sum({})", "volume", 7, 3)}) / ({_roll("avg({})", "volume", 60, 30)}) AS volume_shock FROM p)""", "volume_shock", "asset, ts")),
    "zscore_clip": _q(zscore_clip, rounding(NATION_DAY + f""", a AS (SELECT *, {_roll("avg({})", "close", 120, 40)} AS mean_a, ({_roll("sum(CAST({} AS DECIMAL(28,8)))", "close", 120, 40)})::DOUBLE / count(close) OVER ({W} ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS mean_120, {_roll("stddev_samp({})", "close", 120, 40)} AS s FROM p),
      b AS (SELECT *, greatest(-5, least(5, (close - mean_a) / s)) AS z0 FROM a), c AS (SELECT asset, ts, CASE WHEN close IS NOT NULL AND s IS NOT NULL THEN z0 END AS z, mean_120 FROM b),
      z AS (SELECT asset, ts, round(z, 4) AS z, round(lag(z) OVER ({W}), 4) AS z_lag, mean_120 FROM c)""", "z, z_lag, mean_120", "asset, ts", 6)),
    "carry_features": _q(carry_features, rounding(NATION_DAY + f""", a AS (SELECT *, CASE WHEN volume >= 2 THEN close / 1e6 END AS rate, close / lag(close, 5) OVER ({W}) - 1 AS mom, vol_quote / lag(vol_quote, 5) OVER ({W}) - 1 AS oi0 FROM p),
      b AS (SELECT *, last_value(rate IGNORE NULLS) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS signal, CASE WHEN oi0 IS NOT NULL THEN least(3, greatest(-1, oi0)) END AS oi FROM a),
      c AS (SELECT *, lag(signal) OVER ({W}) AS carry, {_roll("avg({})", "signal", 20, 8)} AS p0 FROM b),
      z AS (SELECT asset, ts, signal, carry, lag(p0) OVER ({W}) AS persistence, oi, CASE WHEN oi IS NOT NULL THEN 0.0::DOUBLE - mom * greatest(oi, 0) END AS crowding, CASE WHEN carry IS NOT NULL THEN mom - greatest(carry, 0) END AS trend_carry FROM c)""", "signal, carry, persistence, oi, crowding, trend_carry", "asset, ts")),
    "dsl_rolling_pack": _q(dsl_rolling_pack, rounding(EVENT_HOURS + f""", z AS (SELECT asset, ts, (close - lag(close, 3) OVER ({W})) / lag(close, 3) OVER ({W}) AS ret3, ln(nullif(greatest(high / nullif(lag(high) OVER ({W}), 0), 0), 0)) AS logret, close - lag(close, 2) OVER ({W}) AS d2,
      {_roll("avg({})", "close", 12)} AS sma12, {_roll("avg({})", "volume", 5)} AS mean5, {_roll("stddev_pop({})", "close", 12)} AS std12, {_roll("quantile_cont({}, 0.5)", "close", 12)} AS med12,
      (close - ({_roll("avg({})", "close", 12)})) / nullif({_roll("stddev_pop({})", "close", 12)}, 0) AS z12,
      4 * ({_roll("stddev_pop({})", "close", 12)}) / ({_roll("avg({})", "close", 12)}) AS bw,
      (close - ({_roll("avg({})", "close", 12)}) + 2 * ({_roll("stddev_pop({})", "close", 12)})) / nullif(4 * ({_roll("stddev_pop({})", "close", 12)}), 0) AS pctb,
      {_roll("max({})", "high", 6)} AS mx, {_roll("min({})", "low", 6)} AS mn, lag(close, 2) OVER ({W}) AS dl, (close + open) / nullif(high + low, 0) AS mix, greatest(open, close) AS hi, least(open, close) AS lo, abs(close * -1) AS ab,
      CASE WHEN close > open THEN high ELSE low END AS sel, CASE WHEN close < open THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag FROM p)""", "ret3, logret, d2, sma12, mean5, std12, med12, z12, bw, pctb, mx, mn, dl, mix, hi, lo, ab, sel, flag", "asset, ts", 5)),
    "ts_rank_window": _q(ts_rank_window, rounding(EVENT_HOURS + f""", a AS (SELECT asset, ts, close, list(close) FILTER (WHERE close IS NOT NULL) OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS v FROM p),
      z AS (SELECT asset, ts, CASE WHEN len(v) >= 12 AND close IS NOT NULL THEN (len(list_filter(v, lambda x: x < close)) + (len(list_filter(v, lambda x: x = close)) + 1) / 2.0::DOUBLE) / 12 END AS rank12 FROM a)""", "rank12", "asset, ts")),
    "ts_corr_window": _q(ts_corr_window, rounding(EVENT_HOURS + f""", z AS (SELECT asset, ts, CASE WHEN count(CASE WHEN close IS NOT NULL THEN volume END) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) >= 24 THEN corr(close, volume) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END AS corr24 FROM p)""", "corr24", "asset, ts")),
    "ffill_limited": _q(ffill_limited, rounding(NATION_DAY + f""", z AS (SELECT asset, ts, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS filled, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled_any FROM p)""", "filled, filled_any", "asset, ts")),
    "lag_daily_asof": _q(lag_daily_asof, rounding(EVENT_HOURS + f""", d AS (SELECT event_type AS asset, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS ts, sum(value) AS v FROM events GROUP BY ALL),
      j AS (SELECT p.asset, p.ts, d.v FROM p LEFT JOIN d ON p.asset = d.asset AND p.ts = d.ts),
      z AS (SELECT asset, ts, last_value(v IGNORE NULLS) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS known FROM j)""", "known", "asset, ts")),
    "asof_unbounded": _q(asof_unbounded, """WITH k AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events),
      l AS (SELECT user_id AS asset, ts, event_id FROM events, k WHERE event_type = a),
      r AS (SELECT user_id AS asset, ts, max(value) AS v FROM events, k WHERE event_type = b GROUP BY ALL)
      SELECT l.asset, l.ts, event_id, round(v, 6) AS last_value FROM l ASOF LEFT JOIN r ON l.asset = r.asset AND l.ts >= r.ts"""),
    "asof_strict": _q(asof_strict, """WITH l AS (SELECT user_id AS asset, ts, event_id, value FROM events),
      r AS (SELECT user_id AS asset, ts, max(value) AS v FROM events GROUP BY ALL)
      SELECT l.asset, l.ts, event_id, round(value, 4) AS value, round(v, 4) AS mid, round(20000.0::DOUBLE * ((value - v) / nullif(v, 0)), 4) AS spread_bp FROM l ASOF LEFT JOIN r ON l.asset = r.asset AND l.ts > r.ts"""),
    "spread_estimators": _q(spread_estimators, rounding(EVENT_DAYS + f""", a AS (SELECT *, high > 0 AND low > 0 AND high >= low AS ok FROM p),
      b AS (SELECT *, CASE WHEN ok THEN high END AS h, CASE WHEN ok THEN low END AS l, CASE WHEN ok AND close > 0 THEN ln(close) END AS c, CASE WHEN ok AND close > 0 THEN (ln(high) + ln(low)) / 2 END AS m FROM a),
      c AS (SELECT *, ln(h / l) ** 2 AS sq, lag(h) OVER ({W}) AS ph, lag(l) OVER ({W}) AS pl FROM b),
      d AS (SELECT *, lag(sq) OVER ({W}) + sq AS beta, CASE WHEN ph IS NOT NULL AND h IS NOT NULL THEN ln(greatest(h, ph) / least(l, pl)) ** 2 END AS gamma, 4 * (lag(c) OVER ({W}) - lag(m) OVER ({W})) * (lag(c) OVER ({W}) - m) AS s2 FROM c),
      e AS (SELECT *, least((sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2.0::DOUBLE)) - sqrt(gamma / (3 - 2 * sqrt(2.0::DOUBLE))), 50) AS alpha FROM d),
      f AS (SELECT *, CASE WHEN beta IS NOT NULL AND gamma IS NOT NULL THEN greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0) END AS cs, CASE WHEN s2 IS NOT NULL THEN sqrt(greatest(s2, 0)) END AS ar FROM e),
      g AS (SELECT asset, ts, {_roll("avg({})", "cs", 5)} AS cs_spread, {_roll("avg({})", "ar", 5)} AS ar_spread FROM f),
      z AS (SELECT *, (cs_spread + ar_spread) / 2 AS composite FROM g)""", "cs_spread, ar_spread, composite", "asset, ts")),
    "turnover_volatility": _q(turnover_volatility, rounding(NATION_MONTH + f""", a AS (SELECT *, vol_quote / (close * 500) AS t0 FROM p), b AS (SELECT asset, ts, CASE WHEN t0 <= 0.9 THEN t0 END AS turnover FROM a),
      z AS (SELECT asset, ts, turnover, {_roll("stddev_samp({})", "turnover", 6)} AS turnover_vol FROM b)""", "turnover, turnover_vol", "asset, ts")),
    "market_beta": _q(market_beta, rounding(NATION_MONTH + f""", a AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r, coalesce(lag(volume > 5) OVER ({W}), false) AS was FROM p),
      b AS (SELECT *, avg(CASE WHEN was THEN r END) OVER (PARTITION BY ts) AS market FROM a),
      c AS (SELECT *, CASE WHEN r IS NOT NULL THEN market END AS x, CASE WHEN market IS NOT NULL THEN r END AS y FROM b),
      d AS (SELECT *, {_roll("avg({})", "x * y", 24, 12)} AS mxy, {_roll("avg({})", "x", 24, 12)} AS mx, {_roll("avg({})", "y", 24, 12)} AS my, {_roll("avg({})", "x * x", 24, 12)} AS mxx FROM c),
      z AS (SELECT asset, ts, market, (mxy - mx * my) / nullif(mxx - mx * mx, 0) AS beta FROM d)""", "market, beta", "asset, ts")),
    "low_vol_signal": _q(low_vol_signal, rounding(NATION_MONTH + f""", a AS (SELECT *, ln(close / lag(close) OVER ({W})) AS lr FROM p), b AS (SELECT *, -({_roll("stddev_samp({})", "lr", 12, 9)}) AS signal FROM a),
      z AS (SELECT asset, ts, signal, lead(close) OVER ({W}) / close - 1 AS next_return FROM b WHERE month(ts) % 3 = 0)""", "signal, next_return", "asset, ts")),
    "observed_history": _q(observed_history, rounding(NATION_DAY + f""", a AS (SELECT *, count(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen, lag(vol_quote) OVER ({W}) AS prev, min(CASE WHEN close IS NOT NULL THEN ts END) OVER (PARTITION BY asset) AS first FROM p),
      b AS (SELECT *, ({_roll("sum({})", "prev", 30, 10)}) / 30 AS turnover_30, epoch(ts - first) / 86400 AS age_days FROM a),
      z AS (SELECT asset, ts, seen, turnover_30, age_days, close IS NOT NULL AND age_days >= 180 AND seen >= 60 AND coalesce(turnover_30 >= 60000, false) AS eligible FROM b)""", "turnover_30, age_days", "asset, ts, seen, eligible", 4)),
    "position_signal": _q(position_signal, rounding(NATION_MONTH + f""", a AS (SELECT asset, ts, (close - ({_roll("avg({})", "close", 24, 8)})) / nullif({_roll("stddev_samp({})", "close", 24, 8)}, 0) AS z0 FROM p),
      z AS (SELECT asset, ts, CASE WHEN z0 IS NULL THEN 0 ELSE greatest(-1, least(1, z0)) END AS pos FROM a)""", "pos", "asset, ts")),
    "update_and_hold": _q(update_and_hold, rounding(NATION_DAY + f""", a AS (SELECT *, date_trunc('month', ts) AS m FROM p), b AS (SELECT *, coalesce(m <> lag(m) OVER ({W}), true) AS u FROM a),
      z AS (SELECT asset, ts, last_value(CASE WHEN u THEN coalesce(close, 0) END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held, u FROM b)""", "held", "asset, ts, u")),
    "supplier_rolling": _q(long_window_beta, rounding(SUPPLIER_MONTH + f""", z AS (SELECT asset, ts, {_roll("avg({})", "close", 24, 12)} AS m, {_roll("stddev_samp({})", "close", 24, 12)} AS s FROM p)""", "m, s", "asset, ts", 4)),
}
