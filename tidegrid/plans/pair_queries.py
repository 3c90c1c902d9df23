"""Queries over portfolios of pairs and the studies made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import change, div
from ..operators import grid, inference, pairs
from ..operators import portfolio as pf
from .panels import rounded, rounding, table

W = "PARTITION BY asset ORDER BY ts"
RUN = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def legs(spark: SparkSession, sf: str) -> DataFrame:
    """Days of nations: urgent orders' mean price is the spot leg, that of all others its twin; funding grows with the orders."""
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("_u"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("asset"))
    bars = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "ts").agg(
        F.avg(F.when(F.col("_u"), F.col("o_totalprice"))).alias("spot"), F.avg(F.when(~F.col("_u"), F.col("o_totalprice"))).alias("perp"), (F.count(F.lit(1)) / 1e5).alias("funding"))
    p = grid.densify(bars.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("asset", "ts", "spot", "perp", "funding"))
    p = p.withColumns({x: grid.fill_forward(x) for x in ("spot", "perp")}).withColumn("funding", F.coalesce("funding", F.lit(0.0)))
    return p.select("asset", "ts", "spot", "perp", "funding", change("spot").alias("rs"), change("perp").alias("rp"), (div("perp", "spot") - 1).alias("basis"))


LEGS = f"""bars AS (SELECT n_name AS asset, date_trunc('day', o_orderdate) AS ts, avg(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice END) AS spot,
    avg(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN o_totalprice END) AS perp, count(*) / 1e5::DOUBLE AS funding
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
p AS (SELECT a.asset, t.ts, spot, perp, funding FROM (SELECT DISTINCT asset FROM bars) a CROSS JOIN (SELECT DISTINCT ts FROM bars) t LEFT JOIN bars b ON a.asset = b.asset AND t.ts = b.ts),
q AS (SELECT asset, ts, last_value(spot IGNORE NULLS) {RUN} AS spot, last_value(perp IGNORE NULLS) {RUN} AS perp, coalesce(funding, 0) AS funding FROM p),
f AS (SELECT *, spot / lag(spot) OVER ({W}) - 1 AS rs, perp / lag(perp) OVER ({W}) - 1 AS rp, perp / spot - 1 AS basis FROM q)"""
#: Monday formations and their weights under both policies.
WEIGHTS = f"""{LEGS}, fm AS (SELECT asset, ts, basis FROM f WHERE dayofweek(ts) = 1),
rk AS (SELECT *, CASE WHEN basis IS NOT NULL THEN row_number() OVER (PARTITION BY ts ORDER BY basis DESC NULLS LAST, asset) END AS k, count(basis) OVER (PARTITION BY ts) AS n FROM fm),
tm AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, max(n) AS n, coalesce(list(asset) FILTER (WHERE k <= greatest(1, ceil(n * 0.2::DOUBLE))), []) AS enter,
  coalesce(list(asset) FILTER (WHERE k <= greatest(1, ceil(n * 0.2::DOUBLE), ceil(n * 0.4::DOUBLE))), []) AS hold FROM rk GROUP BY ts),
st(i, m) AS (SELECT i, CASE WHEN n < 8 THEN [] ELSE enter END FROM tm WHERE i = 1
  UNION ALL SELECT tm.i, CASE WHEN tm.n < 8 THEN [] ELSE list_distinct(list_concat(list_intersect(st.m, tm.hold), tm.enter)) END FROM st JOIN tm ON tm.i = st.i + 1),
fw AS (SELECT 'hysteresis' AS policy, rk.asset, rk.ts, CASE WHEN list_contains(st.m, rk.asset) THEN 0.5::DOUBLE / len(st.m) ELSE 0 END AS w FROM rk JOIN tm ON rk.ts = tm.ts JOIN st ON st.i = tm.i
  UNION ALL SELECT 'top', asset, ts, CASE WHEN k <= 5 THEN 0.5::DOUBLE / least(5, n) ELSE 0 END FROM rk)"""
HELD = f"""{WEIGHTS}, ix AS (SELECT policy, f.*, row_number() OVER (PARTITION BY policy, asset ORDER BY ts) AS i FROM f CROSS JOIN (SELECT unnest(['hysteresis', 'top']) AS policy)),
l AS (SELECT ix.*, last_value(CASE WHEN w IS NOT NULL THEN ix.i END IGNORE NULLS) OVER v AS li, last_value(w IGNORE NULLS) OVER v AS lw FROM ix LEFT JOIN fw ON ix.policy = fw.policy AND ix.asset = fw.asset AND ix.ts = fw.ts
  WINDOW v AS (PARTITION BY ix.policy, ix.asset ORDER BY ix.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h AS (SELECT policy, asset, ts, rs, rp, funding, coalesce(CASE WHEN i - 1 - lag(li) OVER v < 7 THEN lag(lw) OVER v END, 0) AS w FROM l WINDOW v AS (PARTITION BY policy, asset ORDER BY ts))"""


def _pnl_sql(part: str) -> str:
    return f"""tn AS (SELECT *, 2 * abs(w - coalesce(lag(w) OVER (PARTITION BY policy, asset, {part} ORDER BY ts), 0)) AS tv FROM hp),
  pt AS (SELECT policy, {part}, ts, sum(w * (coalesce(rs, 0) - coalesce(rp, 0))) AS gross, -sum(w * funding) AS carry, sum(tv) AS turnover, count(*) FILTER (WHERE w > 1e-12 AND (rs IS NULL OR rp IS NULL)) AS missing FROM tn GROUP BY ALL),
  path AS (SELECT *, turnover * 7 / 10000 AS cost, gross - carry - turnover * 7 / 10000 AS net FROM pt)"""


def _formed(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    fm = legs(spark, sf).where(F.dayofweek("ts") == 2).select("asset", "ts", "basis")
    return {"hysteresis": pairs.hysteresis_weights(fm, "basis", 0.2, 0.4, 8, 1.0, "w"), "top": pairs.top_weights(fm, "basis", 5, 1.0, "w")}


def _held(spark: SparkSession, sf: str) -> DataFrame:
    g = legs(spark, sf).drop("spot", "perp", "basis")
    return reduce(DataFrame.unionByName, [pf.execute_formations(g, w, "w", 1, 7).withColumn("policy", F.lit(n)) for n, w in _formed(spark, sf).items()])


def pair_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly weights of the spot leg by basis: the five highest, and members of the highest fifth kept to two fifths."""
    return rounded(reduce(DataFrame.unionByName, [w.select(F.lit(n).alias("policy"), "asset", "ts", "w") for n, w in _formed(spark, sf).items()]), 8)


def pair_carry(spark: SparkSession, sf: str) -> DataFrame:
    """Spot against its twin by basis under both policies: P&L of both legs by split of the source's period, with its robust t."""
    h = _held(spark, sf)
    path = pairs.pair_pnl(h.join(pairs.source_period_splits(h, SOURCE_END, 0.6), "ts"), "w", "rs", "rp", "funding", part=("policy", "split"))
    m = pf.metrics(path, 365, ("policy", "split")).select("policy", "split", "n", "total", "sharpe", "max_drawdown", "avg_turnover", "cost", "carry", F.col("missing").alias("most_missing"))
    t = inference.newey_west(path, "net", 4, ["policy", "split"]).select("policy", "split", "t")
    return rounded(m.join(t, ["policy", "split"]))


def pair_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 90 days of both policies, each entered anew."""
    h = _held(spark, sf)
    path = pairs.pair_pnl(h.join(pairs.windows_of(h, 90), "ts"), "w", "rs", "rp", "funding", part=("policy", "window"))
    out = path.groupBy("policy", "window").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), pf.sharpe("net", 365).alias("sharpe"), F.sum("net").alias("total"), (-F.sum("carry")).alias("received"), F.sum("cost").alias("cost"))
    return rounded(out.withColumn("positive", F.col("sharpe") > 0))


def source_split(spark: SparkSession, sf: str) -> DataFrame:
    """Days by split: what follows the source's period is holdout, a month end parts the rest."""
    d = legs(spark, sf).select("ts")
    return pairs.source_period_splits(d, SOURCE_END, 0.6)


#: End of the period that the source of the study saw (parameter).
SOURCE_END = "1996-06-30 00:00:00"
_SOURCE = f"""dt AS (SELECT DISTINCT ts FROM f), ef AS (SELECT ts AS e, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM dt WHERE ts <= TIMESTAMP '{SOURCE_END}' AND ts::DATE = last_day(ts)),
  bd AS (SELECT max(e) AS b FROM ef WHERE n >= 3 AND i = least(greatest(floor(n * 0.6::DOUBLE), 1), n - 1)), s AS (SELECT ts, CASE WHEN b IS NULL THEN NULL WHEN ts > TIMESTAMP '{SOURCE_END}' THEN 'holdout' WHEN ts <= b THEN 'is' ELSE 'val' END AS split FROM dt, bd)"""
_T = """n1 AS (SELECT policy, split, ts, net AS x, net - avg(net) OVER (PARTITION BY policy, split) AS e FROM path), n2 AS (SELECT *, lag(e, 1) OVER v AS e1, lag(e, 2) OVER v AS e2, lag(e, 3) OVER v AS e3, lag(e, 4) OVER v AS e4 FROM n1 WINDOW v AS (PARTITION BY policy, split ORDER BY ts)),
  n3 AS (SELECT policy, split, count(*) AS n, avg(x) AS mean, (sum(e * e) + 1.6::DOUBLE * sum(e * e1) + 1.2::DOUBLE * sum(e * e2) + 0.8::DOUBLE * sum(e * e3) + 0.4::DOUBLE * sum(e * e4)) / count(*) AS v FROM n2 GROUP BY ALL),
  c1 AS (SELECT *, sum(net) OVER (PARTITION BY policy, split ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM path), c2 AS (SELECT *, max(cum) OVER (PARTITION BY policy, split ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cum AS dd FROM c1),
  z AS (SELECT c2.policy, c2.split, count(*) AS n, sum(net) AS total, CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) * sqrt(365.0::DOUBLE) ELSE 0 END AS sharpe, max(dd) AS max_drawdown, avg(turnover) AS avg_turnover, sum(cost) AS cost, sum(carry) AS carry, max(missing) AS most_missing,
    any_value(CASE WHEN n3.n >= 8 AND v > 0 THEN mean / sqrt(v / n3.n) END) AS t FROM c2 JOIN n3 ON c2.policy = n3.policy AND c2.split = n3.split GROUP BY ALL)"""
_REC = "RECURSIVE "
QUERIES = {
    "pair_weights": (pair_weights, rounding(_REC + WEIGHTS + ", z AS (SELECT * FROM fw)", "w", "policy, asset, ts", 8)),
    "pair_carry": (pair_carry, rounding(_REC + HELD + ", " + _SOURCE + ", hp AS (SELECT h.*, split FROM h JOIN s ON h.ts = s.ts), " + _pnl_sql("split") + ", " + _T, "total, sharpe, max_drawdown, avg_turnover, cost, carry, t", "policy, split, n, most_missing")),
    "pair_audit": (pair_audit, rounding(_REC + HELD + ', hp AS (SELECT *, CAST(floor((epoch(ts) - min(epoch(ts)) OVER ()) / (86400 * 90)) AS BIGINT) AS "window" FROM h), ' + _pnl_sql('"window"') + """, y AS (SELECT policy, "window", min(ts) AS first, max(ts) AS last, CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) * sqrt(365.0::DOUBLE) ELSE 0 END AS sharpe, sum(net) AS total, -sum(carry) AS received, sum(cost) AS cost FROM path GROUP BY ALL), z AS (SELECT *, sharpe > 0 AS positive FROM y)""", "sharpe, total, received, cost", 'policy, "window", first, last, positive')),
    "source_split": (source_split, "WITH " + LEGS + ", " + _SOURCE + " SELECT ts, split FROM s"),
}
