"""Evidence about candidates: further statistics, portfolio figures and the gates that judge them.

Gates are plain columns over one row a candidate, so a verdict on millions of
candidates is one projection. A missing check counts as failed.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col, div, lag, log, rolling

# The gates that each verdict needs.
WATCHLIST_GATES = ["coverage_ok", "dependence_aware_val_ic_clue", "holdout_noncollapse", "is_not_opposite", "return_evidence_complete_while_held", "val_ic_positive", "val_long_short_positive"]
PASS_GATES = [
    "baseline_incremental_evidence", "coverage_ok", "cscv_pbo_pass", "deflated_sharpe_pass", "dependence_aware_val_ic_clue", "evidence_universe_formal_promotion_allowed", "holdout_ic_positive", "holdout_noncollapse", "holdout_sharpe_positive",
    "is_not_opposite", "multiple_testing_pass", "return_evidence_complete_while_held", "robust_bucket_holdout_not_single_bucket", "robust_bucket_val_not_single_bucket", "robust_family_neutral_holdout_nonnegative",
    "robust_family_neutral_val_ic_positive", "robust_large_liquid_holdout_nonnegative", "robust_large_liquid_val_ic_positive", "rolling_ic_stable", "rolling_sharpe_not_fragile", "turnover_reasonable", "val_ic_positive", "val_long_short_positive",
]
VALIDITY, PRIMARY, QUALITY = ["coverage_ok", "return_evidence_complete_while_held"], ["dependence_aware_val_ic_clue", "val_ic_positive"], ["rolling_ic_stable", "turnover_reasonable", "val_long_short_positive"]
EXECUTION_HARD = ["return_evidence_complete", "funding_evidence_complete", "full_period_net_positive"]
EXECUTION_READY = ["post_source_noncollapse", "double_cost_net_positive", "drawdown_within_limit", "spot_perpetual_tracking_consistent", "current_100u_order_feasibility"]


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    """Mean of x by weight over rows that have both."""
    ok = col(x).isNotNull() & col(w).isNotNull()
    return div(F.sum(F.when(ok, col(x) * col(w))), F.sum(F.when(ok, col(w))))


def trailing_amihud(daily: DataFrame, close: str, turnover: str, days: int, late: int, name: str) -> DataFrame:
    """Mean over ``days`` of daily |log return| over turnover, as known ``late`` days later; all of them must be there."""
    d = daily.withColumn("_i", div(F.abs(log(F.col(close)) - lag(log(F.col(close)))), F.when(F.col(turnover) > 0, F.col(turnover)))).withColumn("_i", lag("_i", late))
    return d.withColumn(name, rolling(F.avg, "_i", days)).drop("_i")


def trailing_sum(df: DataFrame, x: str, rows: int, late: int, name: str) -> DataFrame:
    """Sum of x over ``rows``, as known ``late`` rows later, if any is there."""
    return df.withColumn("_l", lag(x, late)).withColumn(name, rolling(F.sum, "_l", rows, 1)).drop("_l")


def rolling_months(monthly: DataFrame, x: str, months: int, keys: list[str], order: str = "ts") -> DataFrame:
    """Windows of ``months`` returns in a row by key: their number, how many are positive, the least. Missing months are skipped."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = monthly.where(F.col(x).isNotNull()).withColumn("_s", rolling(F.sum, x, months, months, w))
    n, good = F.count("_s"), F.count_if(F.col("_s") > 0)
    return d.groupBy(*keys).agg(n.alias("windows"), good.alias("positive"), F.coalesce(div(good, n), F.lit(0.0)).alias("positive_fraction"), F.coalesce(F.min("_s"), F.lit(0.0)).alias("least"))


def execution_metrics(path: DataFrame, weight: str, ret: str, funding: str, cost_bp: float, keys: list[str]) -> DataFrame:
    """Price, funding by leg, costs, arithmetic and compounded net, draw-down and evidence of held weights (asset, ts) by key."""
    order = Window.partitionBy(*keys, "asset").orderBy("ts")
    w = F.coalesce(F.col(weight), F.lit(0.0))
    d = path.withColumn("_w", w).withColumn("_t", F.abs(w - F.coalesce(F.lag(w).over(order), F.lit(0.0)))).withColumn("_f", F.col("_w") * F.coalesce(F.col(funding), F.lit(0.0)))
    held = F.abs("_w") > 1e-12
    bar = d.groupBy(*keys, "ts").agg(
        F.sum(F.col("_w") * F.coalesce(F.col(ret), F.lit(0.0))).alias("_p"), F.sum("_f").alias("_fund"), F.sum(F.when(F.col("_w") > 1e-12, F.col("_f")).otherwise(0.0)).alias("_long"), F.sum(F.when(F.col("_w") < -1e-12, F.col("_f")).otherwise(0.0)).alias("_short"),
        F.sum("_t").alias("_turn"), F.sum(F.abs("_w")).alias("_gross"), F.count_if(held & F.col(ret).isNull()).alias("_missing"), F.max(held).alias("_active"))
    bar = bar.withColumn("_cost", F.col("_turn") * cost_bp / 1e4).withColumn("_net", F.col("_p") - F.col("_fund") - F.col("_cost"))
    run = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    bar = bar.withColumn("_cum", F.sum("_net").over(run)).withColumn("_dd", F.greatest(F.max("_cum").over(run), F.lit(0.0)) - F.col("_cum"))
    return bar.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"), F.count_if("_active").alias("active_bars"), F.sum("_net").alias("net"), (F.product(1 + F.col("_net")) - 1).alias("compounded"), F.sum("_p").alias("gross"), F.sum("_fund").alias("funding"), F.sum("_long").alias("funding_long"), F.sum("_short").alias("funding_short"),
        F.sum("_cost").alias("cost"), F.sum("_turn").alias("turnover"), F.max("_dd").alias("max_drawdown"), F.avg("_gross").alias("exposure"), F.sum("_missing").alias("missing"), (F.sum("_missing") == 0).alias("complete"))


def fama_macbeth(df: DataFrame, y: str, xs: list[str], least: int) -> DataFrame:
    """Coefficients of y on standardised predictors at each time: ``ts, n, r2, intercept`` and one column a predictor.

    Moments are summed in the cross-section; only they, a row a time, reach the
    solver. Times with fewer than max(least, k + 5) complete rows, a constant
    predictor or dependent ones are left out.
    """
    names = ["_one", *xs, y]
    d = df.select("ts", y, *xs).na.drop().withColumn("_one", F.lit(1.0))
    mean, std = Window.partitionBy("ts"), Window.partitionBy("ts")
    d = d.withColumns({x: div(F.col(x) - F.avg(x).over(mean), F.stddev_samp(x).over(std)) for x in xs})
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    m = d.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i, j in pairs])
    m = m.where(F.col("n") >= max(least, len(xs) + 5)).na.drop()
    outputs = ["r2", "intercept", *xs]
    kind = {f.name: f.dataType.simpleString() for f in m.schema.fields}

    def solve(batches):
        for pdf in batches:
            a = np.zeros((len(pdf), len(names), len(names)))
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = pdf[f"m{i}_{j}"]
            k = len(xs) + 1
            good = np.array([np.linalg.matrix_rank(g) == k for g in a[:, :k, :k]], dtype=bool) if len(pdf) else np.zeros(0, bool)
            a, out = a[good], pdf.loc[good, ["ts", "n"]].reset_index(drop=True)
            beta = np.linalg.solve(a[:, :k, :k], a[:, :k, k][..., None])[..., 0] if len(a) else np.zeros((0, k))
            total = a[:, k, k] - a[:, 0, k] ** 2 / a[:, 0, 0]
            fit = (beta * a[:, :k, k]).sum(axis=1) - a[:, 0, k] ** 2 / a[:, 0, 0]
            with np.errstate(invalid="ignore", divide="ignore"):
                out["r2"] = np.where(total > 0, fit / total, 0.0)
            out[["intercept", *xs]] = beta
            yield pd.DataFrame(out)

    return m.mapInPandas(solve, f"ts {kind['ts']}, n long, " + ", ".join(f"{c} double" for c in outputs))


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def failed(names: list[str]) -> Column:
    """The named checks that do not hold, in the given order."""
    return F.filter(F.array(*[F.when(~_true(n), F.lit(n)) for n in names]), lambda v: v.isNotNull())


def gate_state(check: str, observed: str | None = None, required: str | None = None, applies: Column | None = None) -> Column:
    """pass, fail, insufficient (fewer observations than required) or not_applicable."""
    state = F.when(_true(check), "pass").otherwise("fail")
    if observed and required:
        state = F.when(F.coalesce(F.col(observed), F.lit(0)) < F.coalesce(F.col(required), F.lit(0)), "insufficient").otherwise(state)
    return state if applies is None else F.when(~applies, "not_applicable").otherwise(state)


def verdict_v2(states: Column, watch: list[str] | None = None, whole: list[str] | None = None) -> list[Column]:
    """Verdict and blockers from a map of gate states; a gate without a state is insufficient."""
    def blocked(names: list[str]) -> Column:
        bad = lambda n: F.coalesce(F.element_at(states, F.lit(n)), F.lit("insufficient"))
        return F.filter(F.array(*[F.when(~bad(n).isin("pass", "not_applicable"), F.concat(F.lit(n + ":"), bad(n))) for n in sorted(names)]), lambda v: v.isNotNull())

    w, p = blocked(WATCHLIST_GATES if watch is None else watch), blocked(PASS_GATES if whole is None else whole)
    status = F.when(F.size(w) > 0, "panel_factor_reject").when(F.size(p) > 0, "panel_factor_watchlist").otherwise("panel_factor_pass")
    return [status.alias("status"), F.array_join(F.when(F.size(w) > 0, w).otherwise(p), ",").alias("blockers")]


def verdict_v3(fdr: Column) -> list[Column]:
    """Historical verdict from check columns and the family's false-discovery state; never a formal pass."""
    first, quality = F.concat(failed(VALIDITY), failed(PRIMARY)), failed(QUALITY)
    status = F.when((F.size(first) > 0) | ~_true("holdout_noncollapse"), "historical_reject").when((fdr != "pass") | (F.size(quality) > 0), "historical_clue").otherwise("prospective_eligible")
    blockers = F.when(F.size(first) > 0, F.array_join(first, ",")).when(~_true("holdout_noncollapse"), "holdout_noncollapse").when(fdr != "pass", F.concat(F.lit("family_fdr:"), fdr)).otherwise(F.array_join(quality, ","))
    return [status.alias("status"), blockers.alias("blockers")]


def stage_two(least_assets: int, turnover_limit: float = 0.08) -> dict[str, Column]:
    """Checks on columns ``is_*`` and ``val_*``; there is no way to pass hold-out figures in."""
    c = F.col
    return {
        "coverage_ok": (c("is_coverage") >= least_assets) & (c("val_coverage") >= least_assets), "val_ic_positive": c("val_ic") > 0, "val_long_short_positive": (c("val_sharpe") > 0) & (c("val_total") > 0), "turnover_reasonable": c("val_turnover") < turnover_limit,
        "is_not_opposite": c("is_sharpe") > -0.5, "return_evidence_complete_while_held": c("is_complete") & c("val_complete"),
    }


def verdict_execution() -> list[Column]:
    hard, ready = failed(EXECUTION_HARD), failed(EXECUTION_READY)
    status = F.when(F.size(hard) > 0, "execution_translation_reject").when(F.size(ready) > 0, "execution_translation_watchlist").otherwise("execution_translation_pass_for_paper_design")
    return [status.alias("status"), F.array_join(F.concat(hard, ready), ",").alias("failed_checks")]


def readiness(rules: dict[str, Column]) -> list[Column]:
    """Whether data are ready and the reasons against: ``rules`` say what is wrong; what is not known is wrong."""
    bad = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]), lambda v: v.isNotNull())
    return [(F.size(bad) == 0).alias("ready"), F.array_join(bad, ",").alias("reasons")]


def against_baseline(df: DataFrame, value: str, baseline: str, keys: list[str]) -> DataFrame:
    """Adds the best baseline's value among rows of equal keys and by how much each row exceeds it."""
    best = F.max(F.when(F.col(baseline), F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn("best_baseline", best).withColumn("excess", F.col(value) - F.col("best_baseline"))


def report_order(*keys: Column) -> Column:
    """Place in a report ordered by several keys, from 1."""
    return F.row_number().over(Window.orderBy(*keys))


