"""Queries of the factor catalogue, further statistics, portfolio figures and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import change, lag, rolling
from ..operators import crosssection as xs
from ..operators import evidence as ev
from ..operators import factors, grid, inference
from ..operators import portfolio as pf
from .inference_queries import PATHS, _nw_sql, paths
from .panels import EVENT_DAYS, NATION_DAY, event_days, nation_day, rounded, rounding, table
from .portfolio_queries import FEATURES, _avg_rank_sql, features
from .strategy_queries import _SPLITS

W = "PARTITION BY asset ORDER BY ts"


def _frame(k: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def _roll(agg: str, x: str, k: int, least: int) -> str:
    return f"CASE WHEN count({x}) {_frame(k)} >= {least} THEN {agg.format(x)} {_frame(k)} END"


def _factor_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Days of nations with a reference price (the region's mean), a sparse carry rate and a lagged interest."""
    p = nation_day(spark, sf).withColumn("spot", F.avg("close").over(Window.partitionBy("family", "ts")))
    p = p.withColumn("rate", F.when(F.col("volume") >= 2, F.col("close") / 1e6 - 0.15)).withColumn("funding", grid.fill_forward("rate", 3)).withColumn("open_interest", lag("vol_quote"))
    return p.withColumn("eligible", F.coalesce(F.col("volume") >= 2, F.lit(False)))


def factor_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """All 25 factors on one grid, a row a day."""
    out = factors.compute(_factor_panel(spark, sf), day=1)
    return rounded(out.withColumn("amihud_illiquidity_7d", F.col("amihud_illiquidity_7d") * 1e6), 5)


FACTOR_SQL = NATION_DAY + f""", q AS (SELECT *, avg(close) OVER (PARTITION BY family, ts) AS spot, CASE WHEN volume >= 2 THEN close / 1e6 - 0.15::DOUBLE END AS rate, coalesce(volume >= 2, false) AS el FROM p),
  a AS (SELECT *, last_value(rate IGNORE NULLS) {_frame(4)} AS fu, lag(vol_quote) OVER ({W}) AS oi, close / lag(close) OVER ({W}) - 1 AS r, CASE WHEN vol_quote > 0 THEN vol_quote ELSE close * volume END AS dv, close / lag(close, 7) OVER ({W}) - 1 AS m7, close / spot - 1 AS basis FROM q),
  b AS (SELECT *, oi / lag(oi, 7) OVER ({W}) - 1 AS oi00, {_roll("stddev_samp({})", "r", 7, 3)} AS vol, ln({_roll("avg({})", "dv", 7, 3)}) AS sz, (fu - ({_roll("avg({})", "fu", 90, 30)})) / nullif({_roll("stddev_samp({})", "fu", 90, 30)}, 0) AS fz0, (basis - ({_roll("avg({})", "basis", 90, 30)})) / nullif({_roll("stddev_samp({})", "basis", 90, 30)}, 0) AS bz0,
    {_roll("avg({})", "fu", 14, 5)} AS fm, {_roll("sum(abs({}))", "r", 7, 3)} AS sr, {_roll("sum({})", "dv", 7, 3)} AS sv, {_roll("sum({})", "volume", 1, 1)} AS v1, {_roll("avg({})", "volume", 14, 7)} AS v14 FROM a),
  c AS (SELECT *, CASE WHEN oi00 IS NOT NULL THEN least(3, greatest(-1, oi00)) END AS oi0, CASE WHEN fz0 IS NOT NULL THEN least(5, greatest(-5, fz0)) END AS fz, CASE WHEN bz0 IS NOT NULL THEN least(5, greatest(-5, bz0)) END AS bz FROM b),
  d AS (SELECT *, lag(oi0) OVER ({W}) AS oi1, lag(fu) OVER ({W}) AS f1, lag(fz) OVER ({W}) AS fz1, CASE WHEN el THEN sz END AS es, CASE WHEN el THEN m7 END AS em7, CASE WHEN el THEN r END AS em1, CASE WHEN lag(el) OVER ({W}) THEN lag(fu) OVER ({W}) END AS ef1 FROM c),
  e AS (SELECT *, CASE WHEN oi1 IS NOT NULL THEN greatest(oi1, 0) END AS up, CASE WHEN es IS NOT NULL THEN em7 END AS ym, CASE WHEN em7 IS NOT NULL THEN es END AS xm, CASE WHEN es IS NOT NULL THEN ef1 END AS yf, CASE WHEN ef1 IS NOT NULL THEN es END AS xf, CASE WHEN em7 IS NOT NULL THEN es END AS s7, CASE WHEN em1 IS NOT NULL THEN es END AS s1 FROM d),
  g AS (SELECT *, count(ym) OVER t AS nm, ym - avg(ym) OVER t - coalesce(regr_slope(ym, xm) OVER t, 0) * (xm - avg(xm) OVER t) AS rm, count(yf) OVER t AS nf, yf - avg(yf) OVER t - coalesce(regr_slope(yf, xf) OVER t, 0) * (xf - avg(xf) OVER t) AS rf,
    row_number() OVER (PARTITION BY ts ORDER BY s7 NULLS LAST, asset) AS k7, count(s7) OVER t AS n7, row_number() OVER (PARTITION BY ts ORDER BY s1 NULLS LAST, asset) AS k1, count(s1) OVER t AS n1 FROM e WINDOW t AS (PARTITION BY ts)),
  h AS (SELECT *, CASE WHEN s7 IS NOT NULL AND n7 >= 5 THEN least(2, floor((k7 - 1) * 3 / (n7 - 1)::DOUBLE)) END AS b7, CASE WHEN s1 IS NOT NULL AND n1 >= 5 THEN least(2, floor((k1 - 1) * 3 / (n1 - 1)::DOUBLE)) END AS b1 FROM g),
  j AS (SELECT *, CASE WHEN b7 IS NOT NULL THEN em7 END AS w7, CASE WHEN b1 IS NOT NULL THEN em1 END AS w1 FROM h),
  z AS (SELECT asset, ts, r AS momentum_24h, m7 AS momentum_7d, r AS short_reversal_24h, vol AS low_vol_7d, sz AS liquidity_size, sz - lag(sz, 7) OVER ({W}) AS liquidity_change_7d, sr / sv * 1e6 AS amihud_illiquidity_7d, v1 / nullif(v14, 0) AS volume_shock_24h, f1 AS funding_carry, fz1 AS funding_extreme_reversal,
    CASE WHEN fz1 IS NOT NULL THEN m7 - greatest(fz1, 0) END AS trend_carry_aligned, CASE WHEN nm >= 5 THEN rm END AS liquidity_neutral_momentum_7d, CASE WHEN nf >= 5 THEN rf END AS liquidity_neutral_funding_carry, lag(basis) OVER ({W}) AS basis_carry, lag(fm) OVER ({W}) AS funding_persistence, lag(bz - fz) OVER ({W}) AS basis_funding_dislocation,
    CASE WHEN count(w7) OVER (PARTITION BY ts, b7) > 1 THEN w7 - avg(w7) OVER (PARTITION BY ts, b7) END AS liquidity_bucket_momentum, CASE WHEN count(w1) OVER (PARTITION BY ts, b1) > 1 THEN w1 - avg(w1) OVER (PARTITION BY ts, b1) END AS liquidity_bucket_reversal,
    lag(fu / nullif(vol, 0)) OVER ({W}) AS vol_managed_funding_carry, m7 / nullif(vol, 0) AS vol_managed_momentum, oi1 AS oi_change_7d, m7 * up AS oi_price_crowding_reversal, fz1 * up AS oi_funding_crowding_reversal, m7 * up AS oi_price_crowding_reversal_v2, fz1 * up AS oi_funding_crowding_reversal_v2 FROM j)"""


def weighted_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Mean discount and tax of lines weighted by their notional, by flag."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    return rounded(l.groupBy("l_returnflag").agg(ev.weighted_mean("l_discount", "l_extendedprice").alias("discount"), ev.weighted_mean("l_tax", "l_extendedprice").alias("tax"), F.count(F.lit(1)).alias("n")), 8)


def trailing_illiquidity(spark: SparkSession, sf: str) -> DataFrame:
    """Daily illiquidity over five days, a day late, and carry events summed over ten days, a day late."""
    p = _factor_panel(spark, sf).withColumn("close", grid.fill_forward("close")).withColumn("vol_quote", grid.fill_forward("vol_quote"))
    p = ev.trailing_sum(ev.trailing_amihud(p, "close", "vol_quote", 5, 1, "illiquidity"), "rate", 10, 1, "carry")
    return rounded(p.select("asset", "ts", (F.col("illiquidity") * 1e6).alias("illiquidity"), "carry"))


def rolling_months(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.rolling_months(paths(spark, sf), "r", 12, ["path"]))


def execution_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Rank weights of months held a month, with funding of both legs, by region."""
    p = pf.rank_weights(features(spark, sf), "mom", 5, "w").withColumn("h", pf.held("w")).withColumn("rate", F.when(F.col("volume") >= 8, F.col("close") / 1e8))
    return rounded(ev.execution_metrics(p, "h", "r", "rate", 7, ["family"]), 8)


def fama_macbeth_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients on two standardised predictors at each month and their robust t."""
    f = features(spark, sf)
    c = ev.fama_macbeth(f, "fwd", ["mom", "size"], 8)
    long = c.select("ts", F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.col(n).alias("beta")) for n in ("r2", "intercept", "mom", "size")])).alias("x")).select("ts", "x.*")
    return rounded(inference.newey_west(long, "beta", 3, ["term"]), 5)


def proxy_spearman(spark: SparkSession, sf: str) -> DataFrame:
    """By day, Spearman over event types of a proxy (range over level) and what it stands for (turnover a trade), from four pairs on."""
    d = event_days(spark, sf)
    proxy = d.select("asset", "ts", ((F.col("high") - F.col("low")) / F.col("close")).alias("proxy"))
    cell = d.select("asset", "ts", (F.col("vol_quote") / F.col("volume")).alias("cost"))
    return rounded(xs.rank_ic(proxy.join(cell, ["asset", "ts"]), "proxy", "cost", 4, True))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """A row a path: figures by split and the checks made of them."""
    p = paths(spark, sf)
    m = p.join(grid.splits(p), "ts").groupBy("path").pivot("split", ["is", "val", "holdout"]).agg(pf.sharpe("r", 12).alias("sharpe"), F.sum("r").alias("total"), F.count("r").alias("coverage"), F.avg(F.abs("r")).alias("turnover"))
    c = F.col
    return m.withColumns({
        "coverage_ok": c("val_coverage") >= 10, "return_evidence_complete_while_held": c("is_total") != 0, "val_ic_positive": c("val_total") > -0.05, "dependence_aware_val_ic_clue": c("val_sharpe") > -0.5, "val_long_short_positive": (c("val_sharpe") > 0) & (c("val_total") > 0),
        "is_not_opposite": c("is_sharpe") > -0.5, "holdout_noncollapse": c("holdout_sharpe") > -0.5, "turnover_reasonable": c("is_turnover") < 0.4, "rolling_ic_stable": c("is_sharpe") > 0,
    })


_JUDGED = PATHS + ", " + _SPLITS.format(src="path") + """, m AS (SELECT path, split, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(12.0::DOUBLE), 0) AS sr, sum(r) AS tot, count(r) AS n, avg(abs(r)) AS tv FROM path JOIN s USING (ts) GROUP BY ALL),
  w AS (SELECT path, max(CASE WHEN split = 'val' THEN sr END) AS v, max(CASE WHEN split = 'val' THEN tot END) AS vt, max(CASE WHEN split = 'val' THEN n END) AS vn, max(CASE WHEN split = 'val' THEN tv END) AS vtv, max(CASE WHEN split = 'is' THEN sr END) AS i, max(CASE WHEN split = 'is' THEN tot END) AS it, max(CASE WHEN split = 'is' THEN n END) AS n0,
    max(CASE WHEN split = 'is' THEN tv END) AS tv, max(CASE WHEN split = 'holdout' THEN sr END) AS h, max(CASE WHEN split = 'holdout' THEN tot END) AS ht, max(CASE WHEN split = 'holdout' THEN n END) AS hn FROM m GROUP BY path),
  k AS (SELECT *, vn >= 10 AS coverage_ok, it <> 0 AS complete, vt > -0.05 AS val_ic, v > -0.5 AS clue, v > 0 AND vt > 0 AS val_ls, i > -0.5 AS not_opposite, h > -0.5 AS noncollapse, tv < 0.4 AS turnover_ok, i > 0 AS stable FROM w)"""
_SEVEN = ["turnover_reasonable", "rolling_ic_stable"]


def gates_v2(spark: SparkSession, sf: str) -> DataFrame:
    """Gate states of each path, with evidence counts, and the verdict over the watch list and two more gates."""
    d = _judged(spark, sf).withColumn("need", F.lit(13))
    one = {n: ev.gate_state(n, "val_coverage" if n == "val_ic_positive" else None, "need", F.col("path") != "NATION_3" if n == "rolling_ic_stable" else None) for n in [*ev.WATCHLIST_GATES, *_SEVEN]}
    states = F.create_map(*[x for n, s in one.items() for x in (F.lit(n), s)])
    return d.select("path", *ev.verdict_v2(states, ev.WATCHLIST_GATES, [*ev.WATCHLIST_GATES, *_SEVEN]))


def _block_sql(parts: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {state} NOT IN ('pass', 'not_applicable') THEN '{n}:' || {state} END" for n, state in parts) + "], lambda x: x IS NOT NULL)"


def _gates_sql() -> str:
    name = {"coverage_ok": "coverage_ok", "dependence_aware_val_ic_clue": "clue", "holdout_noncollapse": "noncollapse", "is_not_opposite": "not_opposite", "return_evidence_complete_while_held": "complete", "val_ic_positive": "val_ic", "val_long_short_positive": "val_ls", "turnover_reasonable": "turnover_ok", "rolling_ic_stable": "stable"}
    state = {n: f"(CASE WHEN coalesce({c}, false) THEN 'pass' ELSE 'fail' END)" for n, c in name.items()}
    state["val_ic_positive"] = f"(CASE WHEN vn < 13 THEN 'insufficient' ELSE {state['val_ic_positive']} END)"
    state["rolling_ic_stable"] = f"(CASE WHEN path = 'NATION_3' THEN 'not_applicable' ELSE {state['rolling_ic_stable']} END)"
    watch, whole = [(n, state[n]) for n in sorted(ev.WATCHLIST_GATES)], [(n, state[n]) for n in sorted([*ev.WATCHLIST_GATES, *_SEVEN])]
    return f"WITH {_JUDGED.strip()}, b AS (SELECT path, {_block_sql(watch)} AS w, {_block_sql(whole)} AS p FROM k) SELECT path, CASE WHEN len(w) > 0 THEN 'panel_factor_reject' WHEN len(p) > 0 THEN 'panel_factor_watchlist' ELSE 'panel_factor_pass' END AS status, array_to_string(CASE WHEN len(w) > 0 THEN w ELSE p END, ',') AS blockers FROM b"


def gates_v3(spark: SparkSession, sf: str) -> DataFrame:
    """Historical verdict of each path; the false-discovery state is a pass for even names."""
    d = _judged(spark, sf).withColumn("fdr", F.when(F.col("path").rlike("[02468]$"), "pass").otherwise("incomplete"))
    return d.select("path", *ev.verdict_v3(F.col("fdr")))


_V3 = """WITH {j}, b AS (SELECT *, CASE WHEN regexp_matches(path, '[02468]$') THEN 'pass' ELSE 'incomplete' END AS fdr,
    list_filter([CASE WHEN NOT coverage_ok THEN 'coverage_ok' END, CASE WHEN NOT complete THEN 'return_evidence_complete_while_held' END, CASE WHEN NOT clue THEN 'dependence_aware_val_ic_clue' END, CASE WHEN NOT val_ic THEN 'val_ic_positive' END], lambda x: x IS NOT NULL) AS f,
    list_filter([CASE WHEN NOT stable THEN 'rolling_ic_stable' END, CASE WHEN NOT turnover_ok THEN 'turnover_reasonable' END, CASE WHEN NOT val_ls THEN 'val_long_short_positive' END], lambda x: x IS NOT NULL) AS q FROM k)
  SELECT path, CASE WHEN len(f) > 0 OR NOT noncollapse THEN 'historical_reject' WHEN fdr <> 'pass' OR len(q) > 0 THEN 'historical_clue' ELSE 'prospective_eligible' END AS status,
    CASE WHEN len(f) > 0 THEN array_to_string(f, ',') WHEN NOT noncollapse THEN 'holdout_noncollapse' WHEN fdr <> 'pass' THEN 'family_fdr:' || fdr ELSE array_to_string(q, ',') END AS blockers FROM b"""


def stage_two(spark: SparkSession, sf: str) -> DataFrame:
    """Early stop from the two selection splits."""
    d = _judged(spark, sf).withColumns({"val_ic": F.col("val_total"), "is_complete": F.lit(True), "val_complete": F.col("val_total") != 0, "val_turnover": F.col("val_turnover") / 4})
    from ..operators import audit

    return d.select("path", *audit.status(ev.stage_two(12), "advance_to_stage_3", "reject_before_holdout"))


def execution_verdict(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    d = _judged(spark, sf).withColumns({
        "return_evidence_complete": c("is_coverage") > 30, "funding_evidence_complete": c("val_coverage") > 5, "full_period_net_positive": c("is_total") + c("val_total") + c("holdout_total") > 0, "post_source_noncollapse": c("holdout_sharpe") > -0.5,
        "double_cost_net_positive": c("is_total") > 0.1, "drawdown_within_limit": c("val_total") > -0.3, "spot_perpetual_tracking_consistent": c("is_turnover") < 0.5, "current_100u_order_feasibility": F.lit(True),
    })
    return d.select("path", *ev.verdict_execution())


def data_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each region's days are enough to judge factors on, and why not."""
    d = nation_day(spark, sf).groupBy("family").agg(F.countDistinct("asset").alias("assets"), F.avg(F.col("close").isNotNull().cast("double")).alias("coverage"), F.countDistinct("ts").alias("days"), F.percentile("volume", F.lit(0.5)).alias("median"), F.lit(None).cast("double").alias("oi"))
    c = F.col
    rules = {"loaded_asset_count_below_6": c("assets") < 6, "coverage_below_85pct": c("coverage") < 0.85, "too_few_days": c("days") < 365, "median_volume_below_2": c("median") < 2, "open_interest_unknown": c("oi") < 0.8}
    return rounded(d.select("family", "assets", "days", "coverage", *ev.readiness(rules)))


def baseline_excess(spark: SparkSession, sf: str) -> DataFrame:
    """Sharpe of each path in each split against the best of the baselines (names that end in 0)."""
    p = paths(spark, sf)
    m = p.join(grid.splits(p), "ts").groupBy("path", "split").agg(pf.sharpe("r", 12).alias("sharpe")).withColumn("baseline", F.col("path").endswith("0"))
    d = ev.against_baseline(m, "sharpe", "baseline", ["split"])
    place = ev.report_order(F.desc("beats"), F.round("sharpe", 9).desc(), F.col("split"), F.col("path"))
    return rounded(d.withColumn("beats", F.col("excess") > 0).withColumn("place", place))


def event_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The last events of each kind, by time and id."""
    e = table(spark, sf, "events")
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.withColumn("place", F.row_number().over(w)).where("place <= 20").select("event_type", "place", "event_id", "ts")


def literature_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a registry (JSON rows) that may authorise a candidate, and those ready to be replicated."""
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    use, tier = F.element_at(F.array(F.lit("factor_direction"), F.lit("mechanism_constraint"), F.lit("context")), (F.col("k") % 3 + 1).cast("int")), F.when(F.col("event_type").isin("view", "click"), "peer_reviewed").when(F.col("event_type") == "signup", "working_paper").otherwise("blog")
    d = e.withColumn("allowed_use", use).withColumn("evidence_tier", tier)
    authorises = F.col("allowed_use").isin("factor_direction", "mechanism_constraint") & F.col("evidence_tier").isin("peer_reviewed", "working_paper")
    return d.groupBy("allowed_use", "evidence_tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(authorises).alias("authorising"), F.count_if(F.col("k") % 5 == 0).alias("ready"))


def pruned_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Two factors on demand; nothing else of the catalogue is computed."""
    return rounded(factors.compute(_factor_panel(spark, sf), ["vol_managed_momentum", "oi_price_crowding_reversal"], day=1), 5)


def low_vol_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily low-volatility signal, its rank IC with the next day by month, and how many days had one."""
    p = nation_day(spark, sf).withColumn("close", grid.fill_forward("close")).withColumn("r", change("close")).withColumn("signal", -rolling(F.stddev_samp, "r", 30, 20)).withColumn("fwd", lag("r", -1))
    ic = xs.rank_ic(p, "signal", "fwd", 5, True)
    return rounded(ic.groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.avg("ic").alias("ic"), F.count("ic").alias("days")))


QUERIES = {
    "factor_catalogue": (factor_catalogue, rounding(FACTOR_SQL, ", ".join(factors.CATALOGUE), "asset, ts", 5)),
    "pruned_factors": (pruned_factors, rounding(FACTOR_SQL, "vol_managed_momentum, oi_price_crowding_reversal", "asset, ts", 5)),
    "weighted_spread": (weighted_spread, rounding("z AS (SELECT l_returnflag, sum(l_discount * l_extendedprice) / sum(l_extendedprice) AS discount, sum(l_tax * l_extendedprice) / sum(l_extendedprice) AS tax, count(*) AS n FROM lineitem GROUP BY ALL)", "discount, tax", "l_returnflag, n", 8)),
    "trailing_illiquidity": (trailing_illiquidity, rounding(NATION_DAY + f""", q AS (SELECT asset, ts, CASE WHEN volume >= 2 THEN close / 1e6 - 0.15::DOUBLE END AS rate, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, last_value(vol_quote IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM p),
      i AS (SELECT *, abs(ln(c) - lag(ln(c)) OVER ({W})) / nullif(v, 0) AS i0, lag(rate) OVER ({W}) AS l FROM q), j AS (SELECT *, lag(i0) OVER ({W}) AS i1 FROM i), z AS (SELECT asset, ts, ({_roll("avg({})", "i1", 5, 5)}) * 1e6 AS illiquidity, {_roll("sum({})", "l", 10, 1)} AS carry FROM j)""", "illiquidity, carry", "asset, ts")),
    "rolling_months": (rolling_months, rounding(PATHS + """, a AS (SELECT path, CASE WHEN count(r) OVER w >= 12 THEN sum(r) OVER w END AS s FROM path WINDOW w AS (PARTITION BY path ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
      z AS (SELECT path, count(s) AS windows, count(*) FILTER (WHERE s > 0) AS positive, coalesce(count(*) FILTER (WHERE s > 0) / nullif(count(s), 0)::DOUBLE, 0) AS positive_fraction, coalesce(min(s), 0) AS least FROM a GROUP BY path)""", "positive_fraction, least", "path, windows, positive")),
    "execution_metrics": (execution_metrics, rounding(FEATURES + f""", a AS (SELECT *, CASE WHEN count(mom) OVER (PARTITION BY ts) >= 5 THEN ({_avg_rank_sql("mom")}) / count(mom) OVER (PARTITION BY ts) - 0.5::DOUBLE END AS p0 FROM f), b AS (SELECT *, p0 - avg(p0) OVER (PARTITION BY ts) AS p1 FROM a),
      rw AS (SELECT *, coalesce(p1 / nullif(sum(abs(p1)) OVER (PARTITION BY ts), 0), 0) AS w FROM b), h AS (SELECT *, coalesce(lag(w) OVER ({W}), 0) AS h, CASE WHEN volume >= 8 THEN close / 1e8 END AS rate FROM rw),
      c AS (SELECT *, abs(h - coalesce(lag(h) OVER ({W}), 0)) AS tn, h * coalesce(rate, 0) AS fu FROM h), e AS (SELECT family, ts, sum(h * coalesce(r, 0)) AS g, sum(fu) AS fu, sum(CASE WHEN h > 1e-12 THEN fu ELSE 0 END) AS fl, sum(CASE WHEN h < -1e-12 THEN fu ELSE 0 END) AS fs, sum(tn) AS tn, sum(abs(h)) AS gr, count(*) FILTER (WHERE abs(h) > 1e-12 AND r IS NULL) AS ms, bool_or(abs(h) > 1e-12) AS act FROM c GROUP BY ALL),
      k AS (SELECT *, tn * 7 / 1e4 AS co, g - fu - tn * 7 / 1e4 AS nt FROM e), m AS (SELECT *, sum(nt) OVER (PARTITION BY family ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM k), o AS (SELECT *, greatest(max(cum) OVER (PARTITION BY family ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - cum AS dd FROM m),
      z AS (SELECT family, count(*) AS bars, count(*) FILTER (WHERE act) AS active_bars, sum(nt) AS net, product(1 + nt) - 1 AS compounded, sum(g) AS gross, sum(fu) AS funding, sum(fl) AS funding_long, sum(fs) AS funding_short, sum(co) AS cost, sum(tn) AS turnover, max(dd) AS max_drawdown, avg(gr) AS exposure, CAST(sum(ms) AS BIGINT) AS missing, sum(ms) = 0 AS complete FROM o GROUP BY family)""",
      "net, compounded, gross, funding, funding_long, funding_short, cost, turnover, max_drawdown, exposure", "family, bars, active_bars, missing, complete", 8)),
    "fama_macbeth_multi": (fama_macbeth_multi, rounding(FEATURES + """, g AS (SELECT ts, fwd AS y, mom, size, count(*) OVER (PARTITION BY ts) AS n FROM f WHERE fwd IS NOT NULL AND mom IS NOT NULL AND size IS NOT NULL),
      u AS (SELECT ts, y, n, (mom - avg(mom) OVER t) / stddev_samp(mom) OVER t AS a, (size - avg(size) OVER t) / stddev_samp(size) OVER t AS b FROM g WHERE n >= 8 WINDOW t AS (PARTITION BY ts)),
      m AS (SELECT ts, any_value(n) AS n, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS sy, sum(y) AS s, sum(y * y) AS yy FROM u GROUP BY ts),
      o AS (SELECT ts, s / n AS c0, (bb * ay - ab * sy) / (aa * bb - ab * ab) AS c1, (aa * sy - ab * ay) / (aa * bb - ab * ab) AS c2, ay, sy, yy - s * s / n AS total FROM m),
      l AS (SELECT ts, 'intercept' AS term, c0 AS beta FROM o UNION ALL SELECT ts, 'mom', c1 FROM o UNION ALL SELECT ts, 'size', c2 FROM o UNION ALL SELECT ts, 'r2', (c1 * ay + c2 * sy) / total FROM o), """ + _nw_sql("l", "term", "beta", 3), "mean, se, t", "term, n", 5)),
    "proxy_spearman": (proxy_spearman, rounding(EVENT_DAYS + """, x AS (SELECT a.asset, a.ts, (a.high - a.low) / a.close AS proxy, b.vol_quote / b.volume AS cost FROM p a JOIN p b USING (asset, ts)), """ + f"""y AS (SELECT ts, {_avg_rank_sql("proxy")} AS rx, {_avg_rank_sql("cost")} AS ry FROM x WHERE proxy IS NOT NULL AND cost IS NOT NULL),
      z AS (SELECT ts, CASE WHEN count(*) >= 4 THEN corr(rx, ry) END AS ic, count(*) AS n_pairs FROM y GROUP BY ts)""", "ic", "ts, n_pairs")),
    "gates_v2": (gates_v2, _gates_sql()),
    "gates_v3": (gates_v3, _V3.format(j=_JUDGED.strip())),
    "stage_two": (stage_two, f"""WITH {_JUDGED.strip()}, b AS (SELECT path, list_filter([CASE WHEN NOT (n0 >= 12 AND vn >= 12) THEN 'coverage_ok' END, CASE WHEN NOT vt > 0 THEN 'val_ic_positive' END, CASE WHEN NOT (v > 0 AND vt > 0) THEN 'val_long_short_positive' END, CASE WHEN NOT vtv / 4 < 0.08 THEN 'turnover_reasonable' END, CASE WHEN NOT i > -0.5 THEN 'is_not_opposite' END, CASE WHEN vt = 0 THEN 'return_evidence_complete_while_held' END], lambda x: x IS NOT NULL) AS b FROM k)
      SELECT path, CASE WHEN len(b) = 0 THEN 'advance_to_stage_3' ELSE 'reject_before_holdout' END AS status, array_to_string(b, ',') AS failed_checks FROM b"""),
    "execution_verdict": (execution_verdict, f"""WITH {_JUDGED.strip()}, b AS (SELECT path, list_filter([CASE WHEN NOT n0 > 30 THEN 'return_evidence_complete' END, CASE WHEN NOT vn > 5 THEN 'funding_evidence_complete' END, CASE WHEN NOT it + vt + ht > 0 THEN 'full_period_net_positive' END], lambda x: x IS NOT NULL) AS h,
      list_filter([CASE WHEN NOT h > -0.5 THEN 'post_source_noncollapse' END, CASE WHEN NOT it > 0.1 THEN 'double_cost_net_positive' END, CASE WHEN NOT vt > -0.3 THEN 'drawdown_within_limit' END, CASE WHEN NOT tv < 0.5 THEN 'spot_perpetual_tracking_consistent' END], lambda x: x IS NOT NULL) AS q FROM k)
      SELECT path, CASE WHEN len(h) > 0 THEN 'execution_translation_reject' WHEN len(q) > 0 THEN 'execution_translation_watchlist' ELSE 'execution_translation_pass_for_paper_design' END AS status, array_to_string(list_concat(h, q), ',') AS failed_checks FROM b"""),
    "data_readiness": (data_readiness, rounding(NATION_DAY + """, g AS (SELECT family, count(DISTINCT asset) AS assets, count(DISTINCT ts) AS days, count(close) / count(*)::DOUBLE AS coverage, quantile_cont(volume, 0.5) AS md FROM p GROUP BY family),
      b AS (SELECT *, list_filter([CASE WHEN assets < 6 THEN 'loaded_asset_count_below_6' END, CASE WHEN coverage < 0.85 THEN 'coverage_below_85pct' END, CASE WHEN days < 365 THEN 'too_few_days' END, CASE WHEN coalesce(md < 2, true) THEN 'median_volume_below_2' END, 'open_interest_unknown'], lambda x: x IS NOT NULL) AS b FROM g),
      z AS (SELECT family, assets, days, coverage, len(b) = 0 AS ready, array_to_string(b, ',') AS reasons FROM b)""", "coverage", "family, assets, days, ready, reasons")),
    "baseline_excess": (baseline_excess, rounding(PATHS + ", " + _SPLITS.format(src="path") + """, m AS (SELECT path, split, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(12.0::DOUBLE), 0) AS sharpe, path LIKE '%0' AS baseline FROM path JOIN s USING (ts) GROUP BY ALL),
      b AS (SELECT *, max(CASE WHEN baseline THEN sharpe END) OVER (PARTITION BY split) AS best_baseline FROM m), c AS (SELECT *, sharpe - best_baseline AS excess, sharpe - best_baseline > 0 AS beats FROM b), z AS (SELECT *, row_number() OVER (ORDER BY beats DESC, round(sharpe, 9) DESC, split, path) AS place FROM c)""", "sharpe, best_baseline, excess", "path, split, baseline, beats, place")),
    "event_listing": (event_listing, "SELECT event_type, place, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 20"),
    "literature_filters": (literature_filters, """WITH e AS (SELECT CAST(props->>'$.k' AS BIGINT) AS k, event_type FROM events), d AS (SELECT k, ['factor_direction', 'mechanism_constraint', 'context'][k % 3 + 1] AS allowed_use, CASE WHEN event_type IN ('view', 'click') THEN 'peer_reviewed' WHEN event_type = 'signup' THEN 'working_paper' ELSE 'blog' END AS evidence_tier FROM e)
      SELECT allowed_use, evidence_tier, count(*) AS n, count(*) FILTER (WHERE allowed_use <> 'context' AND evidence_tier <> 'blog') AS authorising, count(*) FILTER (WHERE k % 5 = 0) AS ready FROM d GROUP BY ALL"""),
    "low_vol_daily": (low_vol_daily, rounding(NATION_DAY + f""", q AS (SELECT asset, ts, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM p), a AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r FROM q),
      b AS (SELECT *, -({_roll("stddev_samp({})", "r", 30, 20)}) AS signal, lead(r) OVER ({W}) AS fwd FROM a), y AS (SELECT ts, {_avg_rank_sql("signal")} AS rx, {_avg_rank_sql("fwd")} AS ry FROM b WHERE signal IS NOT NULL AND fwd IS NOT NULL),
      i AS (SELECT ts, CASE WHEN count(*) >= 5 THEN corr(rx, ry) END AS ic FROM y GROUP BY ts), z AS (SELECT date_trunc('month', ts)::TIMESTAMP AS month, avg(ic) AS ic, count(ic) AS days FROM i GROUP BY ALL)""", "ic", "month, days")),
}
