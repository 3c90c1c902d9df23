"""Queries for candidates, guardrails and the remaining audits."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dsl
from ..functions.numeric import change, correlation, div, lag, pair_moments, sample_kurtosis, sample_skew
from ..operators import grid
from ..operators import portfolio as pf
from . import spec
from .audit_queries import LEDGER, _ledger
from .inference_queries import PATHS, paths
from .panels import EVENT_HOURS, NATION_DAY, NATION_MONTH, event_grid, event_hours, nation_day, nation_month, rounded, rounding, table
from .portfolio_queries import _RANKW, FEATURES, _avg_rank_sql, features

W = "PARTITION BY asset ORDER BY ts"
CANDIDATES = [
    {"candidate_id": "c1", "source_ids": ["s1"], "hypothesis": "h", "family": "momentum", "required_fields": ["close"], "panel_formula": "returns(close, 3)", "direction": "long", "neutralization": "none", "bucket_policy": "all", "weighting_modes": ["rank", "top_bottom"], "generated_by": "hand"},
    {"candidate_id": "c2", "source_ids": ["s2"], "hypothesis": "h", "family": "momentum", "required_fields": ["close"], "panel_formula": "returns( close,3 )", "direction": "short", "neutralization": "residual", "bucket_policy": "large_liquid", "weighting_modes": ["rank"], "generated_by": "hand"},
]


def candidate_pnl(spark: SparkSession, sf: str) -> DataFrame:
    """Two candidates over nation months, compiled together."""
    p = nation_month(spark, sf).withColumn("r", change("close")).withColumn("size", F.log("vol_quote"))
    for c in ("open", "high", "low"):
        p = p.withColumn(c, F.col("close"))
    return rounded(spec.evaluate(p, [spec.Candidate.of(c) for c in CANDIDATES], "r"), 8)


def dsl_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Mean lagged return of seed expressions in both directions."""
    seeds = {"a": "returns(close, 1)", "b": "returns(close, 3)", "c": "sub(close, sma(close, 6))", "d": "zscore(volume, 12)"}
    p = nation_month(spark, sf).withColumns({c: F.col("close") for c in ("open", "high", "low")})
    d = dsl.evaluate(p, seeds).withColumn("r", change("close"))
    d = d.select("r", *[F.signum(lag(n)).alias(n) for n in seeds])
    rows = F.array(*[F.struct(F.lit(n).alias("seed"), F.lit(s).alias("direction"), (F.col(n) * s).alias("pos")) for n in seeds for s in (1, -1)])
    out = d.select("r", F.explode(rows).alias("x")).groupBy("x.seed", "x.direction").agg(F.avg(F.col("x.pos") * F.col("r")).alias("mean"), F.count(F.col("x.pos") * F.col("r")).alias("n"))
    return rounded(out, 8)


def regime_split_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each regime are taken out first; windows then run over what is left."""
    p = event_grid(spark, sf).withColumn("close", grid.fill_forward("close"))
    p = p.withColumn("regime", F.when(F.coalesce("volume", F.lit(0.0)) >= 3, "busy").otherwise("calm"))
    w = Window.partitionBy("regime", "asset").orderBy("ts")
    p = p.withColumn("r", change("close", 1, w)).withColumn("pos", F.coalesce(-F.signum(change("close", 2, w)), F.lit(0.0)))
    p = p.withColumn("pnl", F.coalesce(F.lag("pos").over(w) * F.col("r"), F.lit(0.0)))
    return rounded(p.groupBy("regime", "asset").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("total"), pf.sharpe("pnl", 8760).alias("sharpe")).where("n > 100"))


def live_vs_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation and errors between two return paths of one asset."""
    p = nation_month(spark, sf).withColumn("a", change("close")).withColumn("b", change(F.col("vol_quote") / F.col("volume") * (1 + F.col("volume") / 1e4)))
    d = p.where("a IS NOT NULL AND b IS NOT NULL").groupBy("asset").agg(correlation(*pair_moments(F.col("a"), F.col("b"))).alias("corr"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"), F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mse"), F.count(F.lit(1)).alias("n"))
    return rounded(d, 8)


def legacy_deflated_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    """The variance form with the square-root-of-log bar; z only, as p needs the normal distribution."""
    n = F.count("r").cast("double")
    d = paths(spark, sf).groupBy("path").agg(n.alias("n"), div(F.avg("r"), F.stddev_samp("r")).alias("sr"), sample_skew(n, F.skewness("r")).alias("g"), sample_kurtosis(n, F.kurtosis("r")).alias("k"))
    var = (1 + 0.5 * F.col("sr") * F.col("sr") - F.col("g") * F.col("sr") + F.col("k") * F.col("sr") * F.col("sr") / 4) / F.col("n")
    bar = F.sqrt(var) * math.sqrt(2 * math.log(25))
    return rounded(d.select("path", "sr", bar.alias("expected_max"), ((F.col("sr") - bar) / F.sqrt(var)).alias("z")))


def legacy_pbo(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered segment pairs: how often the best path of the earlier is no better than its worst in the later."""
    p = paths(spark, sf)
    seg = p.select("ts").distinct().select("ts", F.ntile(6).over(Window.partitionBy(F.lit(0)).orderBy("ts")).alias("seg"))
    s = p.join(seg, "ts").groupBy("path", "seg").agg(F.avg("r").alias("m"))
    early = s.groupBy("seg").agg(F.max_by("path", F.struct("m", "path")).alias("best"), F.min_by("path", F.struct("m", "path")).alias("worst"))
    late = s.select(F.col("seg").alias("j"), F.col("path"), F.col("m"))
    pair = early.withColumnRenamed("seg", "i").join(late.withColumnsRenamed({"path": "best", "m": "mb"}), "best").where("i < j").join(late.withColumnsRenamed({"path": "worst", "m": "mw"}), ["worst", "j"])
    return rounded(pair.agg(F.avg((F.col("mb") <= F.col("mw")).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("pairs")))


def detectable_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Least mean IC that the universe and blocks of each split can show, for a trial budget."""
    q = NormalDist().inv_cdf
    p = nation_day(spark, sf)
    c = p.groupBy("ts").agg(F.count("close").alias("c")).join(grid.splits(p), "ts")
    z = q(1 - 0.05 / 20) + q(0.8)
    d = c.groupBy("split").agg(F.percentile("c", F.lit(0.5)).alias("assets"), F.floor(F.count(F.lit(1)) / 7).alias("blocks"))
    return rounded(d.withColumn("effect", F.lit(z) / F.sqrt((F.col("assets") - 1) * F.col("blocks"))))


def cost_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Median of daily medians, worst 95th percentile and least fill by event type and notional."""
    h = event_hours(spark, sf).withColumn("day", F.to_date("ts"))
    cell = h.select("asset", "day", F.explode(F.array(*[F.struct(F.lit(float(n)).alias("notional"), (F.col("high") - F.col("low") + F.lit(n / 100)).alias("cost"), F.least(F.lit(1.0), F.col("vol_quote") / n).alias("fill")) for n in (50, 500)])).alias("x")).select("asset", "day", "x.*")
    daily = cell.groupBy("asset", "notional", "day").agg(F.percentile("cost", F.lit(0.5)).alias("m"), F.percentile("cost", F.lit(0.95)).alias("p"), F.min("fill").alias("f"))
    return rounded(daily.groupBy("asset", "notional").agg(F.percentile("m", F.lit(0.5)).alias("median_cost"), F.max("p").alias("worst_p95"), F.min("f").alias("least_fill"), F.count(F.lit(1)).alias("days")))


def calendar_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Days with orders out of all days of each nation's span."""
    d = nation_day(spark, sf).where("close IS NOT NULL").select("asset", F.to_date("ts").alias("day"))
    span = d.groupBy("asset").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = span.select("asset", F.explode(F.sequence("a", "b")).alias("day"))
    out = spine.join(d.withColumn("seen", F.lit(1)), ["asset", "day"], "left").groupBy("asset").agg(F.count(F.lit(1)).alias("days"), F.count("seen").alias("observed"))
    return rounded(out.withColumn("coverage", F.col("observed") / F.col("days")))


def formation_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Median assets at Monday formations by split."""
    p = nation_day(spark, sf)
    c = p.where(F.dayofweek("ts") == 2).groupBy("ts").agg(F.count("close").alias("c")).join(grid.splits(p), "ts")
    return rounded(c.groupBy("split").agg(F.count(F.lit(1)).alias("formations"), F.percentile("c", F.lit(0.5)).alias("median"), F.min("c").alias("least")))


def guardrails(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals in order: a seen formula, a family over budget or a rejected id is turned down; acceptance feeds back.

    The fold runs by family, whose counts are all it needs; a family's
    proposals are one group.
    """
    log = _ledger(spark, sf).groupBy("candidate", "family").agg(F.min("event_id").alias("seq"), F.max("variant_count").alias("variants"), F.min_by("state", "event_id").alias("formula"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used, seen, out = 0, set(), []
        for r in pdf.sort_values("seq").itertuples(index=False):
            key = (r.formula, int(r.variants) % 10)
            why = "duplicate" if key in seen else "budget" if used + r.variants > 600 else ""
            if not why:
                used += int(r.variants)
                seen.add(key)
            out.append((r.candidate, r.family, r.variants, why == "", why))
        return pd.DataFrame(out, columns=["candidate", "family", "variants", "accepted", "reason"])

    return log.groupBy("family").applyInPandas(fold, "candidate long, family string, variants long, accepted boolean, reason string")


def ledger_enrich(spark: SparkSession, sf: str) -> DataFrame:
    """Rows for candidates whose log lacks an event with a signature."""
    log = _ledger(spark, sf)
    signed = log.where("event_id % 97 = 0").select("candidate").distinct()
    return log.join(signed, "candidate", "left_anti").groupBy("candidate").agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n")).withColumn("event", F.lit("enriched"))


def choose_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """The path with the largest (validation Sharpe, total, name)."""
    p = paths(spark, sf)
    m = p.join(grid.splits(p), "ts").where("split = 'val'").groupBy("path").agg(F.round(pf.sharpe("r", 12), 9).alias("s"), F.round(F.sum("r"), 9).alias("t"))
    return rounded(m.agg(F.max(F.struct("s", "t", "path")).alias("x")).select("x.path", F.col("x.s").alias("sharpe"), F.col("x.t").alias("total")))


def experiment_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Tries, best and share that passed, by family; the three best of each."""
    log = _ledger(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("variant_count"), "event_id")))
    return rounded(log.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.max("variant_count").alias("best"), F.avg((F.col("state") == "purchase").cast("double")).alias("passed"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.lpad(F.col("event_id").cast("string"), 9, "0")))), ",").alias("top")))


def benchmark_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Buy and hold, and the naive one-row and three-row signs, for each nation."""
    p = features(spark, sf)
    made = {"hold": F.lit(1.0), "last": F.coalesce(F.signum(lag("r")), F.lit(0.0)), "three": F.coalesce(F.signum(lag("mom")), F.lit(0.0))}
    p = p.select("asset", "r", *[v.alias(k) for k, v in made.items()])
    p = p.select("asset", "r", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("pos")) for k in made])).alias("x"))
    return rounded(p.groupBy("x.name", "asset").agg(F.sum(F.coalesce(F.col("x.pos") * F.col("r"), F.lit(0.0))).alias("total"), pf.sharpe(F.coalesce(F.col("x.pos") * F.col("r"), F.lit(0.0)), 12).alias("sharpe")))


def shadow_observation(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of a day as a map, with its gross and whether all funding hours were there."""
    p = pf.rank_weights(features(spark, sf), "mom", 5, "w").withColumn("h", pf.held("w"))
    g = p.groupBy("ts").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.abs("h") > 1e-9, F.struct("asset", F.round("h", 6).alias("h")))))).alias("m"), F.sum(F.abs("h")).alias("gross"), F.count_if(F.col("volume") < 4).alias("thin"))
    return rounded(g.select("ts", F.size("m").cast("long").alias("held"), F.array_max(F.map_values("m")).alias("largest"), "gross", (F.col("thin") == 0).alias("complete")))


def ic_block_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """Every third IC, as robustness checks sample them."""
    from ..operators import crosssection as xs

    ic = xs.rank_ic(features(spark, sf), "mom", "fwd", 5, False).withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts")) - 1)
    return rounded(ic.where("i % 3 = 0").select("ts", "ic"))


def family_loss_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Longest run of losing months of each region's equal-weight portfolio."""
    p = features(spark, sf).groupBy("family", "ts").agg(F.avg("r").alias("r")).where("r IS NOT NULL").withColumn("r", F.round("r", 9))
    w = Window.partitionBy("family").orderBy("ts")
    p = p.withColumn("wins", F.sum((F.col("r") >= 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = p.where("r < 0").groupBy("family", "wins").agg(F.count(F.lit(1)).alias("n"))
    return run.groupBy("family").agg(F.max("n").alias("longest"))


def instrument_listing_age(spark: SparkSession, sf: str) -> DataFrame:
    """Age in days at the last event since the first, by user."""
    e = table(spark, sf, "events")
    return rounded(e.groupBy("user_id").agg(((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 86400e6).alias("age_days"), F.count(F.lit(1)).alias("n")))


_SPLITS = """t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM {src})),
  s AS (SELECT ts, CASE WHEN pos < floor(n * 0.5::DOUBLE) THEN 'is' WHEN pos < floor(n * 0.5::DOUBLE) + floor(n * 0.17::DOUBLE) THEN 'val' ELSE 'holdout' END AS split FROM t)"""
_Z = NormalDist().inv_cdf(1 - 0.05 / 20) + NormalDist().inv_cdf(0.8)
QUERIES = {
    "candidate_pnl": (candidate_pnl, None),
    "dsl_sweep": (dsl_sweep, rounding(NATION_MONTH + f""", a AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r, (close - lag(close) OVER ({W})) / lag(close) OVER ({W}) AS a, (close - lag(close, 3) OVER ({W})) / lag(close, 3) OVER ({W}) AS b,
      close - CASE WHEN count(close) OVER w6 >= 6 THEN avg(close) OVER w6 END AS c, CASE WHEN count(volume) OVER w12 >= 12 THEN (volume - avg(volume) OVER w12) / nullif(stddev_pop(volume) OVER w12, 0) END AS d FROM p WINDOW w6 AS ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), w12 AS ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
      l AS (SELECT r, lag(a) OVER ({W}) AS a, lag(b) OVER ({W}) AS b, lag(c) OVER ({W}) AS c, lag(d) OVER ({W}) AS d FROM a),
      u AS (SELECT 'a' AS seed, sign(a) AS p, r FROM l UNION ALL SELECT 'b', sign(b), r FROM l UNION ALL SELECT 'c', sign(c), r FROM l UNION ALL SELECT 'd', sign(d), r FROM l),
      z AS (SELECT seed, k AS direction, avg(p * k * r) AS mean, count(p * r) AS n FROM u CROSS JOIN (SELECT unnest([1, -1]) AS k) GROUP BY ALL)""", "mean", "seed, direction, n", 8)),
    "regime_split_backtest": (regime_split_backtest, rounding(EVENT_HOURS + f""", q AS (SELECT asset, ts, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close, CASE WHEN coalesce(volume, 0) >= 3 THEN 'busy' ELSE 'calm' END AS regime FROM p),
      a AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r, coalesce(-sign(close / nullif(lag(close, 2) OVER w, 0) - 1), 0) AS pos FROM q WINDOW w AS (PARTITION BY regime, asset ORDER BY ts)),
      b AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY regime, asset ORDER BY ts) * r, 0) AS pnl FROM a), z AS (SELECT regime, asset, count(*) AS n, sum(pnl) AS total, avg(pnl) / stddev_samp(pnl) * sqrt(8760.0::DOUBLE) AS sharpe FROM b GROUP BY ALL HAVING count(*) > 100)""", "total, sharpe", "regime, asset, n")),
    "live_vs_backtest": (live_vs_backtest, rounding(NATION_MONTH + f""", a AS (SELECT asset, ts, close / lag(close) OVER ({W}) - 1 AS a, vol_quote / volume * (1 + volume / 1e4) AS v FROM p), b AS (SELECT asset, a, v / lag(v) OVER ({W}) - 1 AS b FROM a),
      z AS (SELECT asset, corr(a, b) AS corr, avg(abs(a - b)) AS mae, avg((a - b) * (a - b)) AS mse, count(*) AS n FROM b WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY asset)""", "corr, mae, mse", "asset, n", 8)),
    "legacy_deflated_sharpe": (legacy_deflated_sharpe, rounding(PATHS + f""", g AS (SELECT path, count(r) AS n, avg(r) / stddev_samp(r) AS sr, skewness(r) AS g, kurtosis(r) AS k FROM path GROUP BY path), v AS (SELECT *, (1 + 0.5 * sr * sr - g * sr + k * sr * sr / 4) / n AS var FROM g),
      z AS (SELECT path, sr, sqrt(var) * {math.sqrt(2 * math.log(25))!r}::DOUBLE AS expected_max, (sr - sqrt(var) * {math.sqrt(2 * math.log(25))!r}::DOUBLE) / sqrt(var) AS z FROM v)""", "sr, expected_max, z", "path")),
    "legacy_pbo": (legacy_pbo, rounding(PATHS + """, sg AS (SELECT ts, ntile(6) OVER (ORDER BY ts) AS seg FROM (SELECT DISTINCT ts FROM path)), s AS (SELECT path, seg, avg(r) AS m FROM path JOIN sg USING (ts) GROUP BY ALL),
      e AS (SELECT seg, arg_max(path, (m, path)) AS best, arg_min(path, (m, path)) AS worst FROM s GROUP BY seg), z AS (SELECT avg(CASE WHEN b.m <= w.m THEN 1.0::DOUBLE ELSE 0 END) AS pbo, count(*) AS pairs FROM e JOIN s b ON b.path = e.best AND b.seg > e.seg JOIN s w ON w.path = e.worst AND w.seg = b.seg)""", "pbo", "pairs")),
    "detectable_effect": (detectable_effect, rounding(NATION_DAY + ", " + _SPLITS.format(src="p") + f""", c AS (SELECT ts, count(close) AS c FROM p GROUP BY ts), g AS (SELECT split, quantile_cont(c, 0.5) AS assets, CAST(floor(count(*) / 7.0::DOUBLE) AS BIGINT) AS blocks FROM c JOIN s USING (ts) GROUP BY split), z AS (SELECT *, {_Z!r}::DOUBLE / sqrt((assets - 1) * blocks) AS effect FROM g)""", "assets, effect", "split, blocks")),
    "cost_surface": (cost_surface, rounding(EVENT_HOURS + """, c AS (SELECT asset, ts::DATE AS day, n AS notional, high - low + n / 100 AS cost, least(1, vol_quote / n) AS fill FROM bars CROSS JOIN (SELECT unnest([50.0::DOUBLE, 500.0::DOUBLE]) AS n)),
      d AS (SELECT asset, notional, day, quantile_cont(cost, 0.5) AS m, quantile_cont(cost, 0.95) AS p, min(fill) AS f FROM c GROUP BY ALL), z AS (SELECT asset, notional, quantile_cont(m, 0.5) AS median_cost, max(p) AS worst_p95, min(f) AS least_fill, count(*) AS days FROM d GROUP BY ALL)""", "notional, median_cost, worst_p95, least_fill", "asset, days")),
    "calendar_coverage": (calendar_coverage, rounding(NATION_DAY + """, z AS (SELECT asset, CAST(date_diff('day', min(ts), max(ts)) + 1 AS BIGINT) AS days, count(*) AS observed, count(*) / (date_diff('day', min(ts), max(ts)) + 1)::DOUBLE AS coverage FROM p WHERE close IS NOT NULL GROUP BY asset)""", "coverage", "asset, days, observed")),
    "formation_coverage": (formation_coverage, rounding(NATION_DAY + ", " + _SPLITS.format(src="p") + """, c AS (SELECT ts, count(close) AS c FROM p WHERE dayofweek(ts) = 1 GROUP BY ts), z AS (SELECT split, count(*) AS formations, quantile_cont(c, 0.5) AS median, min(c) AS least FROM c JOIN s USING (ts) GROUP BY split)""", "median", "split, formations, least")),
    "guardrails": (guardrails, "WITH RECURSIVE " + LEDGER + """, c AS (SELECT candidate, family, min(event_id) AS seq, max(variant_count) AS variants, arg_min(state, event_id) AS formula FROM lg GROUP BY candidate, family),
      r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY seq) AS i, formula || '|' || (variants % 10) AS k FROM c),
      f(family, i, candidate, variants, used, seen, reason) AS (SELECT family, i, candidate, variants, CASE WHEN variants > 600 THEN 0::BIGINT ELSE variants END, CASE WHEN variants > 600 THEN []::VARCHAR[] ELSE [k] END, CASE WHEN variants > 600 THEN 'budget' ELSE '' END FROM r WHERE i = 1
        UNION ALL SELECT r.family, r.i, r.candidate, r.variants, CASE WHEN list_contains(f.seen, r.k) OR f.used + r.variants > 600 THEN f.used ELSE f.used + r.variants END, CASE WHEN list_contains(f.seen, r.k) OR f.used + r.variants > 600 THEN f.seen ELSE list_append(f.seen, r.k) END,
          CASE WHEN list_contains(f.seen, r.k) THEN 'duplicate' WHEN f.used + r.variants > 600 THEN 'budget' ELSE '' END FROM f JOIN r ON r.family = f.family AND r.i = f.i + 1)
      SELECT candidate, family, variants, reason = '' AS accepted, reason FROM f"""),
    "ledger_enrich": (ledger_enrich, f"WITH {LEDGER} SELECT candidate, min(ts) AS ts, count(*) AS n, 'enriched' AS event FROM lg WHERE candidate NOT IN (SELECT candidate FROM lg WHERE event_id % 97 = 0) GROUP BY candidate"),
    "choose_candidate": (choose_candidate, rounding(PATHS + ", " + _SPLITS.format(src="path") + """, m AS (SELECT path, round(avg(r) / stddev_samp(r) * sqrt(12.0::DOUBLE), 9) AS sharpe, round(sum(r), 9) AS total FROM path JOIN s USING (ts) WHERE split = 'val' GROUP BY path), z AS (SELECT * FROM m ORDER BY sharpe DESC, total DESC, path DESC LIMIT 1)""", "sharpe, total", "path")),
    "experiment_summary": (experiment_summary, f"WITH {LEDGER}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY variant_count DESC, event_id) AS rn FROM lg) SELECT family, count(*) AS n, max(variant_count) AS best, round(avg(CASE WHEN state = 'purchase' THEN 1.0::DOUBLE ELSE 0 END), 6) AS passed, string_agg(lpad(event_id::VARCHAR, 9, '0'), ',' ORDER BY lpad(event_id::VARCHAR, 9, '0')) FILTER (WHERE rn <= 3) AS top FROM r GROUP BY family"),
    "benchmark_positions": (benchmark_positions, rounding(FEATURES + f""", l AS (SELECT asset, r, coalesce(sign(lag(r) OVER ({W})), 0) AS a, coalesce(sign(lag(mom) OVER ({W})), 0) AS b FROM f),
      u AS (SELECT 'hold' AS name, asset, coalesce(r, 0) AS x FROM l UNION ALL SELECT 'last', asset, coalesce(a * r, 0) FROM l UNION ALL SELECT 'three', asset, coalesce(b * r, 0) FROM l), z AS (SELECT name, asset, sum(x) AS total, avg(x) / stddev_samp(x) * sqrt(12.0::DOUBLE) AS sharpe FROM u GROUP BY ALL)""", "total, sharpe", "name, asset")),
    "shadow_observation": (shadow_observation, rounding(FEATURES + ", " + _RANKW + f""", hw AS (SELECT *, coalesce(lag(w) OVER ({W}), 0) AS h FROM rw), z AS (SELECT ts, count(*) FILTER (WHERE abs(h) > 1e-9) AS held, max(round(h, 6)) FILTER (WHERE abs(h) > 1e-9) AS largest, sum(abs(h)) AS gross, count(*) FILTER (WHERE volume < 4) = 0 AS complete FROM hw GROUP BY ts)""", "largest, gross", "ts, held, complete")),
    "ic_block_sampling": (ic_block_sampling, rounding(FEATURES + f""", a AS (SELECT ts, {_avg_rank_sql("mom")} AS x, {_avg_rank_sql("fwd")} AS y FROM f), g AS (SELECT ts, CASE WHEN count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) >= 5 THEN corr(x, y) END AS ic FROM a GROUP BY ts),
      n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i FROM g), z AS (SELECT ts, ic FROM n WHERE i % 3 = 0)""", "ic", "ts")),
    "family_loss_streak": (family_loss_streak, "WITH " + FEATURES.strip() + """, a AS (SELECT family, ts, round(avg(r), 9) AS r FROM f GROUP BY ALL HAVING avg(r) IS NOT NULL), b AS (SELECT *, sum(CASE WHEN r >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY family ORDER BY ts) AS wins FROM a), c AS (SELECT family, wins, count(*) AS n FROM b WHERE r < 0 GROUP BY ALL) SELECT family, max(n) AS longest FROM c GROUP BY family"""),
    "instrument_listing_age": (instrument_listing_age, "SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6::DOUBLE, 6) AS age_days, count(*) AS n FROM events GROUP BY user_id"),
}
