"""Queries that judge return paths and factor evidence."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import change
from ..operators import crosssection as xs
from ..operators import inference as st
from .panels import NATION_MONTH, nation_month, rounded, rounding
from .portfolio_queries import FEATURES, features

W = "PARTITION BY asset ORDER BY ts"
#: Monthly P&L of each nation on the sign of its own momentum: one path a nation.
PATHS = FEATURES + f""", path AS (SELECT asset AS path, ts, coalesce(sign(lag(mom) OVER ({W})) * r, 0) AS r FROM f)"""


def paths(spark: SparkSession, sf: str) -> DataFrame:
    f = features(spark, sf)
    sign = F.signum(F.lag("mom").over(Window.partitionBy("asset").orderBy("ts")))
    return f.select(F.col("asset").alias("path"), "ts", F.coalesce(sign * F.col("r"), F.lit(0.0)).alias("r"))


def hac_mean_t(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.newey_west(paths(spark, sf), "r", 4, ["path"]))


def block_mean_t(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.block_t(paths(spark, sf), "r", 7, ["path"]))


def _p_values(spark: SparkSession, sf: str) -> DataFrame:
    """Rational p values from the t statistics, 1 / (1 + t squared): they need no normal distribution in the oracle."""
    t = paths(spark, sf).groupBy(F.col("path").alias("id")).agg(st.mean_t("r").alias("t"))
    return t.withColumn("p", F.round(1 / (1 + F.col("t") * F.col("t")), 6))


P_SQL = PATHS + """, pv AS (SELECT path AS id, round(1 / (1 + (avg(r) / (stddev_samp(r) / sqrt(count(r)))) ** 2), 6) AS p FROM path GROUP BY path),
  o AS (SELECT *, row_number() OVER (ORDER BY p, id) AS j, count(*) OVER () AS m FROM pv)"""


def fdr_bh(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.false_discovery(_p_values(spark, sf), "p", 0.1, "adjusted").select("id", "p", "adjusted", "passed"))


def fdr_by(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.false_discovery(_p_values(spark, sf), "p", 0.05, "adjusted", dependent=True).select("id", "p", "adjusted", "passed"))


def sidak(spark: SparkSession, sf: str) -> DataFrame:
    d = _p_values(spark, sf)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return rounded(d.select("id", "p", st.sidak(F.col("p"), n).alias("sidak"), F.least(F.lit(1.0), F.col("p") * n).alias("bonferroni")))


def path_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Bias-corrected skewness and kurtosis of each path."""
    n = F.count("r").cast("double")
    return rounded(paths(spark, sf).groupBy("path").agg(st.sample_skew(n, F.skewness("r")).alias("skew"), st.sample_kurtosis(n, F.kurtosis("r")).alias("kurt")))


def deflated_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(st.deflated_sharpe(paths(spark, sf)))


def cscv_choices(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen path and its out-of-sample rank for each of the 70 halves of eight segments."""
    return rounded(st.cscv_pbo(paths(spark, sf), 8).select(F.col("choice").cast("long").alias("choice"), "path", "omega", "logit"))


def cscv_pbo(spark: SparkSession, sf: str) -> DataFrame:
    d = st.cscv_pbo(paths(spark, sf), 8)
    return rounded(d.agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("n_choices")))


_CSCV = PATHS + """, sg AS (SELECT ts, ntile(8) OVER (ORDER BY ts) - 1 AS seg FROM (SELECT DISTINCT ts FROM path)),
  ss AS (SELECT path, seg, count(r) AS n, sum(r) AS s, sum(r * r) AS q FROM path JOIN sg USING (ts) GROUP BY ALL),
  c AS (SELECT row_number() OVER (ORDER BY a, b, c, d) - 1 AS choice, [a, b, c, d] AS tr FROM range(8) x(a), range(8) y(b), range(8) v(c), range(8) w(d) WHERE a < b AND b < c AND c < d),
  h AS (SELECT choice, path, list_contains(tr, seg) AS train, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM ss, c GROUP BY ALL),
  sr AS (SELECT *, s / n / sqrt((q - s * s / n) / (n - 1)) AS sr FROM h),
  bo AS (SELECT choice, path, max(CASE WHEN train THEN sr END) AS a, max(CASE WHEN NOT train THEN sr END) AS b FROM sr GROUP BY ALL),
  rk AS (SELECT *, (rank() OVER (PARTITION BY choice ORDER BY b) + (count(*) OVER (PARTITION BY choice, b) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY choice) + 1) AS omega, row_number() OVER (PARTITION BY choice ORDER BY a DESC, path) AS fi FROM bo),
  be AS (SELECT choice, path, omega, ln(omega / (1 - omega)) AS logit FROM rk WHERE fi = 1)"""


def ols_hac_1(spark: SparkSession, sf: str) -> DataFrame:
    """The first nation's return on the mean of all, with two lags."""
    p = nation_month(spark, sf).withColumn("r", change("close"))
    m = p.groupBy("ts").agg(F.avg("r").alias("market"), F.min_by("r", "asset").alias("own"))
    rows = st.ols_hac(m, "own", ["market"], 2)
    return rounded(spark.createDataFrame([tuple(r.values()) for r in rows], "term string, beta double, se double, t double, n long"))


def fama_macbeth_1(spark: SparkSession, sf: str) -> DataFrame:
    """Mean slope of the next return on momentum over time, with its robust t."""
    s = st.slopes(features(spark, sf), "fwd", "mom", 5).withColumn("model", F.lit("mom"))
    return rounded(st.newey_west(s, "slope", 3, ["model"]))


def _nw_sql(source: str, key: str, x: str, lags: int) -> str:
    terms = " + ".join(f"CASE WHEN least({lags}, n - 2) >= {k} THEN 2 * (1 - {k}.0::DOUBLE / (least({lags}, n - 2) + 1)) * coalesce(s{k}, 0) / n ELSE 0 END" for k in range(1, lags + 1))
    es = ", ".join(f"lag(e, {k}) OVER (PARTITION BY {key} ORDER BY ts) AS e{k}" for k in range(1, lags + 1))
    ss = ", ".join(f"sum(e * e{k}) AS s{k}" for k in range(1, lags + 1))
    return f"""n1 AS (SELECT {key}, ts, {x} AS x, {x} - avg({x}) OVER (PARTITION BY {key}) AS e FROM {source} WHERE {x} IS NOT NULL), n2 AS (SELECT *, {es} FROM n1),
      n3 AS (SELECT {key}, count(*) AS n, avg(x) AS mean, sum(e * e) AS s0, {ss} FROM n2 GROUP BY {key}),
      n4 AS (SELECT {key}, n, mean, sqrt(greatest(s0 / n + {terms}, 0) / n) AS se FROM n3), z AS (SELECT *, mean / se AS t FROM n4)"""


def ar1_inference_power(spark: SparkSession, sf: str) -> DataFrame:
    """How often a robust t above 1.645 is met by autocorrelated series with no mean and with one."""
    def draw(seed: int) -> dict:
        rng = np.random.default_rng([17, seed])
        mean = 0.25 * (seed % 2)
        x = mean + st.ar1(rng, 120, 0.25, 1.0)
        e = x - x.mean()
        lrv = (e @ e + 2 * sum((1 - k / 5) * (e[k:] @ e[:-k]) for k in range(1, 5))) / len(x)
        return {"mean": float(mean), "t": float(x.mean() / math.sqrt(max(lrv, 1e-18) / len(x)))}

    d = st.seeded_draws(spark, 400, "mean double, t double", draw).groupBy("mean").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") > 1.645).alias("k"))
    low, high = st.wilson(F.col("k"), F.col("n").cast("double"))
    return d.select("mean", "n", "k", low.alias("low"), high.alias("high"))


def permutation_control(spark: SparkSession, sf: str) -> DataFrame:
    """Mean IC against shuffles of the forward returns within months; one seed a row."""
    f = features(spark, sf).where("mom IS NOT NULL AND fwd IS NOT NULL").select("asset", "ts", "mom", "fwd")
    k = Window.partitionBy("ts", "seed")
    seeds = spark.range(20).select(F.col("id").alias("seed"))
    s = f.crossJoin(F.broadcast(seeds))  # 20 seeds
    s = s.withColumn("i", F.row_number().over(k.orderBy("asset"))).withColumn("j", F.row_number().over(k.orderBy(F.xxhash64("seed", "ts", "asset"))))
    other = s.select("ts", "seed", F.col("j").alias("i"), F.col("fwd").alias("shuffled"))
    ic = xs.rank_ic(s.join(other, ["ts", "seed", "i"]), "mom", "shuffled", 5, True, ["ts", "seed"]).groupBy("seed").agg(F.avg("ic").alias("null_ic"))
    real = xs.rank_ic(f, "mom", "fwd", 5, True).agg(F.avg("ic").alias("ic"))
    return ic.crossJoin(F.broadcast(real)).agg(F.first("ic").alias("ic"), ((F.count_if(F.col("null_ic") >= F.col("ic")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"), F.count(F.lit(1)).alias("n_seeds"))


def gate_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Synthetic gate: share of candidates that pass with and without an edge, over seeds."""
    def draw(seed: int) -> dict:
        rng = np.random.default_rng([23, seed])
        edge = 0.1 * (seed % 3)
        r = edge * 0.3 + rng.normal(0, 1, 600)
        parts = np.split(r, [360, 480])
        s = [float(x.mean() / x.std(ddof=1)) for x in parts]
        return {"edge": float(edge), "passed": bool(s[0] > -0.05 and s[1] > 0 and s[2] > 0)}

    d = st.seeded_draws(spark, 300, "edge double, passed boolean", draw).groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("k"))
    low, high = st.wilson(F.col("k"), F.col("n").cast("double"))
    return d.select("edge", "n", "k", low.alias("low"), high.alias("high"))


QUERIES = {
    "hac_mean_t": (hac_mean_t, rounding(PATHS + ", " + _nw_sql("path", "path", "r", 4), "mean, se, t", "path, n")),
    "block_mean_t": (block_mean_t, rounding(PATHS + """, b0 AS (SELECT *, (row_number() OVER (PARTITION BY path ORDER BY ts) - 1) // 7 AS b FROM path), b1 AS (SELECT path, b, avg(r) AS m FROM b0 GROUP BY ALL HAVING count(*) = 7),
      z AS (SELECT path, count(*) AS n_blocks, avg(m) AS mean, CASE WHEN count(m) >= 3 THEN avg(m) / (stddev_samp(m) / sqrt(count(m))) END AS t FROM b1 GROUP BY path)""", "mean, t", "path, n_blocks")),
    "fdr_bh": (fdr_bh, rounding(P_SQL + ", z AS (SELECT id, p, least(1, min(p * m / j) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adjusted, adjusted <= 0.1 AS passed FROM o)", "p, adjusted", "id, passed")),
    "fdr_by": (fdr_by, rounding(P_SQL + ", o2 AS (SELECT *, sum(1.0::DOUBLE / j) OVER () AS c FROM o), z AS (SELECT id, p, least(1, min(p * m * c / j) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adjusted, adjusted <= 0.05 AS passed FROM o2)", "p, adjusted", "id, passed")),
    "sidak": (sidak, rounding(P_SQL + ", z AS (SELECT id, p, 1 - (1 - p) ** m AS sidak, least(1, p * m) AS bonferroni FROM o)", "p, sidak, bonferroni", "id")),
    "path_moments": (path_moments, rounding(PATHS + ", z AS (SELECT path, skewness(r) AS skew, kurtosis(r) AS kurt FROM path GROUP BY path)", "skew, kurt", "path")),
    "deflated_sharpe": (deflated_sharpe, None),
    "cscv_choices": (cscv_choices, rounding(_CSCV + ", z AS (SELECT * FROM be)", "omega, logit", "choice, path")),
    "cscv_pbo": (cscv_pbo, rounding(_CSCV + ", z AS (SELECT avg(CASE WHEN logit <= 0 THEN 1.0::DOUBLE ELSE 0 END) AS pbo, count(*) AS n_choices FROM be)", "pbo", "n_choices")),
    "ols_hac_1": (ols_hac_1, rounding(NATION_MONTH + f""", a AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r FROM p), m AS (SELECT ts, avg(r) AS x, arg_min_null(r, asset) AS y FROM a GROUP BY ts),
      d AS (SELECT * FROM m WHERE x IS NOT NULL AND y IS NOT NULL), g AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, sum((x - (SELECT avg(x) FROM d)) ** 2) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d),
      u AS (SELECT ts, x, y - g.a - g.b * x AS u FROM d, g),
      q AS (SELECT ts, (1 / g.n - g.mx * (x - g.mx) / g.sxx) * u AS ga, (x - g.mx) / g.sxx * u AS gb FROM u, g),
      l AS (SELECT *, lag(ga) OVER o AS ga1, lag(ga, 2) OVER o AS ga2, lag(gb) OVER o AS gb1, lag(gb, 2) OVER o AS gb2 FROM q WINDOW o AS (ORDER BY ts)),
      v AS (SELECT sum(ga * ga) + 2 * (2.0::DOUBLE / 3 * sum(ga * ga1) + 1.0::DOUBLE / 3 * sum(ga * ga2)) AS va, sum(gb * gb) + 2 * (2.0::DOUBLE / 3 * sum(gb * gb1) + 1.0::DOUBLE / 3 * sum(gb * gb2)) AS vb FROM l),
      z AS (SELECT 'intercept' AS term, a AS beta, sqrt(va * n / (n - 2)) AS se, a / sqrt(va * n / (n - 2)) AS t, CAST(n AS BIGINT) AS n FROM g, v UNION ALL SELECT 'market', b, sqrt(vb * n / (n - 2)), b / sqrt(vb * n / (n - 2)), CAST(n AS BIGINT) FROM g, v)""", "beta, se, t", "term, n")),
    "fama_macbeth_1": (fama_macbeth_1, rounding(FEATURES + """, sl AS (SELECT 'mom' AS model, ts, regr_slope(fwd, mom) AS slope FROM f WHERE fwd IS NOT NULL AND mom IS NOT NULL GROUP BY ts HAVING count(*) >= 5), """ + _nw_sql("sl", "model", "slope", 3), "mean, se, t", "model, n")),
    "ar1_inference_power": (ar1_inference_power, None),
    "permutation_control": (permutation_control, None),
    "gate_calibration": (gate_calibration, None),
}
