"""Queries over coverage, ledgers, sets, order books and scalar functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import change, div, lag
from ..operators import audit, grid, ledger, recursive, upsert
from ..operators import crosssection as xs
from .panels import ema_cte, EVENT_HOURS, NATION_DAY, NATION_MONTH, event_grid, event_hours, nation_day, nation_month, rounded, rounding, table
from .portfolio_queries import DAY, _RANKW, _REBAL, _weekly

W = "PARTITION BY asset ORDER BY ts"


def coverage_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage by family and split with their totals."""
    p = nation_day(spark, sf)
    p = p.join(grid.splits(p).select("ts", "split"), "ts")
    out = p.rollup("family", "split").agg(F.count(F.lit(1)).alias("n"), audit.coverage("close").alias("coverage"), audit.coverage(F.when(F.col("volume") > 1, F.col("close")), F.col("close").isNotNull()).alias("thick"))
    return rounded(out.select(F.coalesce("family", F.lit("(all)")).alias("family"), F.coalesce("split", F.lit("(all)")).alias("split"), "n", "coverage", "thick"))


def asset_audit(spark: SparkSession, sf: str) -> DataFrame:
    p = nation_day(spark, sf)
    d = p.groupBy("asset").agg(F.min(F.when(F.col("close").isNotNull(), F.col("ts"))).alias("first"), F.max(F.when(F.col("close").isNotNull(), F.col("ts"))).alias("last"), *audit.summary("close"))
    return rounded(d, 4)


def eligibility_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = nation_day(spark, sf)
    t = p.groupBy("ts").agg(F.count_if(F.col("volume") >= 2).alias("c")).join(grid.splits(p), "ts")
    q = F.percentile("c", F.array(F.lit(0.5), F.lit(0.1)))
    return rounded(t.groupBy("split").agg(q[0].alias("median"), q[1].alias("p10"), F.min("c").alias("least"), F.max("c").alias("most"), F.count_if(F.col("c") >= 5).alias("usable")))


def funding_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Longest gap in hours, and head and tail of each asset's events."""
    h = event_hours(spark, sf).where("volume >= 3")
    gap = (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(lag("ts").cast("timestamp"))) / 3600
    return rounded(h.withColumn("g", gap).groupBy("asset").agg(F.max("g").alias("longest"), F.min("ts").alias("head"), F.max("ts").alias("tail"), F.count(F.lit(1)).alias("n")))


def contribution_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Assets' share of P&L, the ten largest by size."""
    p = _weekly(spark, sf).groupBy("asset").agg(F.coalesce(F.sum(F.col("h") * F.col("r")), F.lit(0.0)).alias("gross"))
    total = Window.partitionBy(F.lit(0))
    p = p.withColumn("share", div(F.abs("gross"), F.sum(F.abs("gross")).over(total)))
    return rounded(p.orderBy(F.desc(F.abs("gross")), "asset").limit(10), 8)


def regime_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mean return under overlapping conditions."""
    p = nation_month(spark, sf).withColumn("r", change("close"))
    masks = F.array(F.lit("all"), F.when(F.month("ts") <= 6, F.lit("first_half")), F.when(F.col("r") < 0, F.lit("down")), F.when(F.col("volume") >= 8, F.lit("busy")))
    return rounded(p.where("r IS NOT NULL").select(F.explode(F.filter(masks, lambda m: m.isNotNull())).alias("regime"), "r").groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.avg((F.col("r") > 0).cast("double")).alias("positive")))


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    n = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("user_id").alias("candidate"), F.col("event_type").alias("state"), "ts", "event_id", n.alias("variant_count"), F.array(F.concat(F.lit("s"), F.col("user_id") % 7), F.concat(F.lit("t"), F.col("event_id") % 3)).alias("source_ids"), F.concat(F.lit("f"), F.col("user_id") % 5).alias("family"))


LEDGER = """lg AS (SELECT user_id AS candidate, event_type AS state, ts, event_id, CAST(props->>'$.k' AS BIGINT) AS variant_count, ['s' || (user_id % 7), 't' || (event_id % 3)] AS source_ids, 'f' || (user_id % 5) AS family FROM events)"""


def trial_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.trial_counts(_ledger(spark, sf), "family")


def source_trial_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.source_counts(_ledger(spark, sf))


def run_index_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.latest(_ledger(spark, sf), "candidate", ["ts", "event_id"], ["state", "ts"])


def status_best(spark: SparkSession, sf: str) -> DataFrame:
    states = ("view", "click", "signup", "purchase", "refund")
    return ledger.best_status(_ledger(spark, sf), "candidate", "state", states)


def query_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = _ledger(spark, sf).select(F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"), "state", "family")
    return ledger.query_runs(r, 50, family="f2", state=None)


def family_budget(spark: SparkSession, sf: str) -> DataFrame:
    log = _ledger(spark, sf)
    cut = datetime(2024, 1, 15)
    used = ledger.trial_counts(log.where(F.col("ts") < F.lit(cut)), "family").withColumnRenamed("variants", "used")
    new = log.where(F.col("ts") >= F.lit(cut)).groupBy("candidate", "family").agg(F.min("event_id").alias("seq"), F.max("variant_count").alias("variant_count"))
    return ledger.family_budget(new, used, 4000).select("candidate", "family", "variant_count", "running", "accepted")


def next_source(spark: SparkSession, sf: str) -> DataFrame:
    used = ledger.source_counts(_ledger(spark, sf))
    return ledger.next_source(used.select("source", F.col("source").startswith("s").alias("admitted")), used, 10**9)


def failure_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Checks failed by nations, and how often each failed."""
    p = nation_month(spark, sf).withColumn("r", change("close")).groupBy("asset").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.count("close").alias("n"), F.max("volume").alias("v"))
    checks = {"coverage": F.col("n") >= 79, "mean": F.col("m") > 0.03, "risk": F.col("s") < 0.35, "volume": F.col("v") >= 14}
    v = p.select("asset", *audit.status(checks))
    return v.select("asset", "status", "failed_checks", F.explode_outer(F.split("failed_checks", ",")).alias("check")).groupBy("status", "check").agg(F.count(F.lit(1)).alias("n"), F.min("asset").alias("first"))


def semi_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose nation passes a screen, then those without a large order."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    good = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("b")).where("b > 4400")
    return c.join(good, "c_nationkey", "left_semi").join(o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


def diff_compare(spark: SparkSession, sf: str) -> DataFrame:
    p = nation_month(spark, sf).select("asset", "ts", "close")
    other = p.where(F.dayofyear("ts") > 31).withColumn("close", F.when(F.month("ts") == 5, F.col("close") * 1.001).when(F.month("ts") == 6, F.lit(None)).otherwise(F.col("close")))
    return audit.compare(p, other, ["asset", "ts"], "close", 1e-9, 1e-6).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def pit_differential(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks of a causal feature and of one that looks ahead."""
    p = nation_month(spark, sf).select("asset", "ts", "close")
    honest = lambda d: d.withColumn("f", change("close", 3))
    ahead = lambda d: d.withColumn("f", lag("close", -1))
    cut = datetime(1998, 6, 1)
    out = [audit.leaks(p, b, "f", cut, ["close"]).agg(F.count(F.lit(1)).alias("leaks")).withColumn("feature", F.lit(n)) for n, b in (("honest", honest), ("ahead", ahead))]
    return out[0].unionByName(out[1]).select("feature", (F.col("leaks") > 0).alias("leaks"))


def crash_windows_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the market within three days of its five deepest falls."""
    p = nation_day(spark, sf).groupBy("ts").agg(F.avg("close").alias("m")).withColumn("one", F.lit("m"))
    p = p.withColumn("r", F.round(div("m", F.lag("m").over(Window.partitionBy("one").orderBy("ts"))) - 1, 9))
    w = audit.crash_windows(p, "r", 3, 2, 7, 5)
    out = grid.in_windows(p.select("ts", "r"), w)
    return rounded(out.groupBy("crash", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("total")).select(F.col("at"), "n", "total"))


def rolling_90d(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows of 90 days from the first row."""
    p = nation_day(spark, sf).groupBy("ts").agg(F.sum("vol_quote").alias("v"))
    start = F.min("ts").over(Window.partitionBy(F.lit(0)))
    k = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))) / (90 * 86400))
    return rounded(p.select(k.alias("window"), "ts", "v").groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("from"), F.sum("v").alias("total")), 2)


def array_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Near-equal consecutive parts of the months, the first ones longer."""
    t = nation_month(spark, sf).select("ts").distinct()
    return t.select("ts", F.ntile(7).over(Window.partitionBy(F.lit(0)).orderBy("ts")).cast("long").alias("part"))


def upsert_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 2)).withColumn("o_orderstatus", F.lit("U"))
    return upsert.keep_last(o, new, keys=["o_orderkey"])


def set_ops(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("k"))
    b = table(spark, sf, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_nationkey").cast("long").alias("k"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "minus": a.subtract(b)}
    out = None
    for name, d in parts.items():
        d = d.select(F.lit(name).alias("op"), "k")
        out = d if out is None else out.unionByName(d)
    return out


def first_of_key(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.keep_first(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_linenumber", "l_partkey"])


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k long"))
    return rounded(e.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count_if(F.col("p.k").isNull()).alias("n_null"), F.avg("value").alias("mean")))


def array_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Length, norm and top element of each vector."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return rounded(table(spark, sf, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dims"), norm.alias("norm"), F.array_max(v).alias("top")), 5)


def string_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Edit similarity of the names of nations, compared within a region."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("i"), F.lower("n_name").alias("a"), "n_regionkey")
    m = n.select(F.col("i").alias("j"), F.col("a").alias("b"), "n_regionkey")
    lev = F.levenshtein("a", "b")
    out = n.join(m, "n_regionkey").where("i < j").select("i", "j", lev.cast("long").alias("edits"), (1 - lev / F.greatest(F.length("a"), F.length("b"), F.lit(1))).alias("similarity"))
    return rounded(out.withColumn("crowded", F.col("similarity") > 0.85))


def hash_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey"), ledger.row_hash("s_suppkey", "s_name", "s_nationkey").alias("sha"))


def calendar_months(spark: SparkSession, sf: str) -> DataFrame:
    """Month starts over the orders' range, with the orders in each."""
    o = table(spark, sf, "orders").select(F.trunc("o_orderdate", "MM").alias("month"))
    ends = o.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return spine.join(o.groupBy("month").agg(F.count(F.lit(1)).alias("n")), "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


#: Expression families by their words, first of equals wins (fixed values).
FAMILIES = {"momentum": ("returns", "ema", "sma"), "volatility": ("std", "atr", "bb_"), "volume": ("volume",), "reversal": ("rsi", "zscore")}


def classify_expressions(spark: SparkSession, sf: str) -> DataFrame:
    """Family of expressions by the number of words that they hold."""
    texts = [(i, t) for i, t in enumerate(["ema(close, 5)", "std(returns(close, 1), 9)", "mul(volume, rsi(close, 14))", "close", "sub(sma(close, 3), ema(close, 9))", "zscore(volume, 20)"])]
    d = spark.createDataFrame(texts, "id long, expr string")
    score = lambda words: sum((F.lower("expr").contains(w).cast("int") for w in words), F.lit(0))
    best = F.array_max(F.array(*[F.struct(score(w).alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("f")) for i, (n, w) in enumerate(FAMILIES.items())]))
    return d.select("id", F.when(best["s"] > 0, best["f"]).otherwise("other").alias("family"))


def lot_rounding(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in whole lots of a contract, half to even, and what is lost."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_quantity") * 37.0).alias("want"))  # noqa: E741
    unit = F.col("price") * 0.01
    lots = F.bround(F.col("want") / unit, 0)
    got = F.greatest(lots, F.lit(1.0)) * unit
    return rounded(l.select("l_orderkey", "l_linenumber", lots.alias("lots"), F.round(F.abs(got / F.col("want") - 1), 6).alias("error")))


#: Order lines that one task of the book takes: tasks grow in number with the table, not in size.
BOOK_ROWS = 100_000


def book_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as book levels: odd lines bid, even lines ask above them."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    side = F.when(F.col("l_linenumber") % 2 == 1, "bid").otherwise("ask")
    price = F.when(side == "bid", 1000 - F.col("l_linenumber") * 0.4 - F.col("l_discount")).otherwise(1000 + F.col("l_linenumber") * 0.3 + F.col("l_tax"))
    levels = l.select(F.col("l_orderkey"), side.alias("side"), price.alias("price"), (F.col("l_quantity") / 20).alias("size"))
    levels = levels.repartition(-(-max(l.count(), 1) // BOOK_ROWS), "l_orderkey")  # the one exchange: levels and windows keep to it
    levels = levels.groupBy("l_orderkey", "side", "price").agg(F.sum("size").alias("size"))
    return rounded(audit.book_metrics(levels, ["l_orderkey"], (5, 25), (1000, 5000)), 8)


def ema_pack(spark: SparkSession, sf: str) -> DataFrame:
    out = recursive.by_asset(event_grid(spark, sf), ["ema12"], lambda d: {"ema12": recursive.ema(d["close"].to_numpy(dtype=float), 12)}, ["close"])
    return rounded(out.select("asset", "ts", "ema12"), 6)


def rsi_atr_adx(spark: SparkSession, sf: str) -> DataFrame:
    def work(d):
        h, l, c = (d[x].to_numpy(dtype=float) for x in ("high", "low", "close"))  # noqa: E741
        return {"rsi": recursive.rsi(c, 14), **recursive.regime(h, l, c), "squeeze": recursive.squeeze(h, l, c, 20, 2.0, 20, 1.5)}

    names = ["rsi", "atr", "atr_ratio", "plus_di", "minus_di", "adx", "trend", "squeeze"]
    return rounded(recursive.by_asset(event_hours(spark, sf), names, work, ["high", "low", "close"]).select("asset", "ts", *names))


def market_cap_scope(spark: SparkSession, sf: str) -> DataFrame:
    p = nation_month(spark, sf)
    return p.select("asset", "ts", xs.at_least_median("vol_quote", F.col("close").isNotNull()).alias("large"))


_BOOK = """lv AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 1 THEN 'bid' ELSE 'ask' END AS side,
    CASE WHEN l_linenumber % 2 = 1 THEN 1000 - l_linenumber * 0.4::DOUBLE - l_discount ELSE 1000 + l_linenumber * 0.3::DOUBLE + l_tax END AS price, sum(l_quantity / 20) AS size FROM lineitem GROUP BY ALL),
  m AS (SELECT *, max(CASE WHEN side = 'bid' THEN price END) OVER (PARTITION BY l_orderkey) AS bid, min(CASE WHEN side = 'ask' THEN price END) OVER (PARTITION BY l_orderkey) AS ask, price * size AS v FROM lv),
  b AS (SELECT *, (bid + ask) / 2 AS mid, coalesce(sum(v) OVER (PARTITION BY l_orderkey, side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM m),
  c AS (SELECT *, abs(price / mid - 1) * 1e4 AS bp FROM b)"""


def _sweep_cols() -> str:
    out = []
    for s, sign in (("ask", 1), ("bid", -1)):
        for t in (1000, 5000):
            q = f"sum(CASE WHEN side = '{s}' THEN greatest(0, least(v, {t} - bf)) END)"
            base = f"sum(CASE WHEN side = '{s}' THEN greatest(0, least(v, {t} - bf)) / price END)"
            out += [f"{q} / {t} AS {s}_fill_{t}", f"CASE WHEN {q} / {t} >= 1 - 1e-9 THEN {sign} * ({q} / nullif({base}, 0) / max(mid) - 1) * 1e4 END AS {s}_impact_{t}"]
    for s in ("bid", "ask"):
        for d in (5, 25):
            out.append(f"coalesce(sum(CASE WHEN side = '{s}' AND bp <= {d} THEN v END), 0) AS {s}_depth_{d}")
    return ", ".join(out)


_BOOK_D = "bid, ask, mid, spread_bp, bid_depth_5, ask_depth_5, imbalance_5, bid_depth_25, ask_depth_25, imbalance_25, ask_fill_1000, ask_impact_1000, bid_fill_1000, bid_impact_1000, ask_fill_5000, ask_impact_5000, bid_fill_5000, bid_impact_5000"
SPLIT = """t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM p)),
  s AS (SELECT ts, CASE WHEN pos < floor(n * 0.5::DOUBLE) THEN 'is' WHEN pos < floor(n * 0.5::DOUBLE) + floor(n * 0.17::DOUBLE) THEN 'val' ELSE 'holdout' END AS split FROM t)"""
QUERIES = {
    "coverage_audit": (coverage_audit, rounding(NATION_DAY + ", " + SPLIT + """, z AS (SELECT coalesce(family, '(all)') AS family, coalesce(split, '(all)') AS split, count(*) AS n, count(close) / count(*)::DOUBLE AS coverage, count(*) FILTER (WHERE close IS NOT NULL AND volume > 1) / count(close)::DOUBLE AS thick FROM p JOIN s USING (ts) GROUP BY ROLLUP (family, split))""", "coverage, thick", "family, split, n")),
    "asset_audit": (asset_audit, rounding(NATION_DAY + """, z AS (SELECT asset, min(CASE WHEN close IS NOT NULL THEN ts END) AS first, max(CASE WHEN close IS NOT NULL THEN ts END) AS last, count(close) AS n, avg(close) AS mean, quantile_cont(close, 0.05) AS p05, quantile_cont(close, 0.25) AS p25, quantile_cont(close, 0.5) AS median, quantile_cont(close, 0.75) AS p75, quantile_cont(close, 0.95) AS p95 FROM p GROUP BY asset)""", "mean, p05, p25, median, p75, p95", "asset, first, last, n", 4)),
    "eligibility_summary": (eligibility_summary, rounding(NATION_DAY + ", " + SPLIT + """, e AS (SELECT ts, count(*) FILTER (WHERE volume >= 2) AS c FROM p GROUP BY ts), z AS (SELECT split, quantile_cont(c, 0.5) AS median, quantile_cont(c, 0.1) AS p10, min(c) AS least, max(c) AS most, count(*) FILTER (WHERE c >= 5) AS usable FROM e JOIN s USING (ts) GROUP BY split)""", "median, p10", "split, least, most, usable")),
    "funding_gaps": (funding_gaps, rounding(EVENT_HOURS + f""", g AS (SELECT asset, ts, epoch(ts - lag(ts) OVER ({W})) / 3600 AS g FROM bars WHERE volume >= 3), z AS (SELECT asset, max(g) AS longest, min(ts) AS head, max(ts) AS tail, count(*) AS n FROM g GROUP BY asset)""", "longest", "asset, head, tail, n")),
    "contribution_topk": (contribution_topk, rounding(f"""{DAY}, {_RANKW}, {_REBAL}, g AS (SELECT asset, coalesce(sum(h * r), 0) AS gross FROM hw GROUP BY asset), z AS (SELECT *, abs(gross) / sum(abs(gross)) OVER () AS share FROM g ORDER BY abs(gross) DESC, asset LIMIT 10)""", "gross, share", "asset", 8)),
    "regime_summary": (regime_summary, rounding(NATION_MONTH + f""", a AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r FROM p), b AS (SELECT r, unnest(list_filter(['all', CASE WHEN month(ts) <= 6 THEN 'first_half' END, CASE WHEN r < 0 THEN 'down' END, CASE WHEN volume >= 8 THEN 'busy' END], lambda x: x IS NOT NULL)) AS regime FROM a WHERE r IS NOT NULL),
      z AS (SELECT regime, count(*) AS n, avg(r) AS mean, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) AS positive FROM b GROUP BY regime)""", "mean, positive", "regime, n")),
    "trial_counts": (trial_counts, f"WITH {LEDGER}, o AS (SELECT candidate, family, max(variant_count) AS v FROM lg GROUP BY ALL) SELECT family, CAST(sum(v) AS BIGINT) AS variants, count(*) AS candidates FROM o GROUP BY family"),
    "source_trial_counts": (source_trial_counts, f"WITH {LEDGER}, u AS (SELECT candidate, unnest(source_ids) AS source, variant_count FROM lg), o AS (SELECT source, candidate, max(variant_count) AS v FROM u GROUP BY ALL) SELECT source, CAST(sum(v) AS BIGINT) AS variants, count(*) AS candidates FROM o GROUP BY source"),
    "run_index_latest": (run_index_latest, f"WITH {LEDGER} SELECT candidate, arg_max(state, (ts, event_id)) AS state, max(ts) AS ts, count(*) AS n_events FROM lg GROUP BY candidate"),
    "status_best": (status_best, f"WITH {LEDGER}, r AS (SELECT candidate, coalesce(max(list_position(['view', 'click', 'signup', 'purchase', 'refund'], state)), 0) AS level FROM lg GROUP BY candidate) SELECT candidate, ['view', 'click', 'signup', 'purchase', 'refund'][greatest(level, 1)] AS best_state, CAST(level AS BIGINT) AS level FROM r"),
    "query_runs": (query_runs, f"WITH {LEDGER} SELECT event_id AS run_id, ts AS created_at, state, family FROM lg WHERE family = 'f2' ORDER BY created_at DESC, run_id DESC LIMIT 50"),
    "family_budget": (family_budget, f"""WITH {LEDGER}, o AS (SELECT candidate, family, max(variant_count) AS v FROM lg WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL), u AS (SELECT family, sum(v) AS used FROM o GROUP BY family),
      nw AS (SELECT candidate, family, min(event_id) AS seq, max(variant_count) AS variant_count FROM lg WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL),
      r AS (SELECT candidate, nw.family, variant_count, CAST(coalesce(used, 0) + sum(variant_count) OVER (PARTITION BY nw.family ORDER BY seq) AS BIGINT) AS running FROM nw LEFT JOIN u ON nw.family = u.family) SELECT *, running <= 4000 AS accepted FROM r"""),
    "next_source": (next_source, f"WITH {LEDGER}, u AS (SELECT candidate, unnest(source_ids) AS source, variant_count FROM lg), o AS (SELECT source, candidate, max(variant_count) AS v FROM u GROUP BY ALL) SELECT source, CAST(sum(v) AS BIGINT) AS n FROM o WHERE source LIKE 's%' GROUP BY source ORDER BY n, source LIMIT 1"),
    "failure_counts": (failure_counts, "WITH " + NATION_MONTH.strip() + f""", a AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r FROM p), g AS (SELECT asset, avg(r) AS m, stddev_samp(r) AS s, count(close) AS n, max(volume) AS v FROM a GROUP BY asset),
      f AS (SELECT asset, list_filter([CASE WHEN n >= 79 THEN NULL ELSE 'coverage' END, CASE WHEN m > 0.03 THEN NULL ELSE 'mean' END, CASE WHEN s < 0.35 THEN NULL ELSE 'risk' END, CASE WHEN v >= 14 THEN NULL ELSE 'volume' END], lambda x: x IS NOT NULL) AS b FROM g),
      x AS (SELECT asset, CASE WHEN len(b) = 0 THEN 'pass' ELSE 'reject' END AS status, unnest(CASE WHEN len(b) = 0 THEN [''] ELSE b END) AS "check" FROM f) SELECT status, "check", count(*) AS n, min(asset) AS first FROM x GROUP BY ALL"""),
    "semi_survivors": (semi_survivors, "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING avg(c_acctbal) > 4400) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "diff_compare": (diff_compare, "WITH " + NATION_MONTH.strip() + """, o AS (SELECT asset, ts, CASE WHEN month(ts) = 5 THEN close * 1.001::DOUBLE WHEN month(ts) = 6 THEN NULL ELSE close END AS close FROM p WHERE dayofyear(ts) > 31),
      j AS (SELECT p.close AS a, o.close AS b, p.asset AS x, o.asset AS y FROM p FULL OUTER JOIN o ON p.asset = o.asset AND p.ts = o.ts) SELECT CASE WHEN y IS NULL THEN 'missing' WHEN x IS NULL THEN 'extra' WHEN a IS NULL AND b IS NULL THEN 'equal' WHEN a IS NULL OR b IS NULL THEN 'null_mismatch' WHEN abs(a - b) <= 1e-9 + 1e-6 * abs(a) THEN 'equal' ELSE 'value_mismatch' END AS kind, count(*) AS n FROM j GROUP BY 1"""),
    "pit_differential": (pit_differential, "SELECT * FROM (VALUES ('honest', false), ('ahead', true)) t(feature, leaks)"),
    "crash_windows_join": (crash_windows_join, "WITH RECURSIVE " + NATION_DAY.strip() + """, m AS (SELECT ts, avg(close) AS m FROM p GROUP BY ts), r AS (SELECT ts, round(m / lag(m) OVER (ORDER BY ts) - 1, 9) AS r FROM m),
      d0 AS (SELECT ts, CASE WHEN count(r) OVER w >= 2 THEN sum(r) OVER w END AS depth FROM r WINDOW w AS (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
      d AS (SELECT ts, row_number() OVER (ORDER BY depth, ts) AS i FROM d0 WHERE depth IS NOT NULL),
      g(i, taken) AS (SELECT 1, (SELECT [ts] FROM d WHERE i = 1) UNION ALL SELECT d.i, CASE WHEN len(g.taken) < 5 AND len(list_filter(g.taken, lambda t: abs(epoch(d.ts) - epoch(t)) < 604800)) = 0 THEN list_append(g.taken, d.ts) ELSE g.taken END FROM g JOIN d ON d.i = g.i + 1 WHERE d.i <= 320),
      c AS (SELECT unnest(taken) AS "at" FROM (SELECT taken FROM g ORDER BY i DESC LIMIT 1)) SELECT c."at", count(*) AS n, round(sum(r), 6) + 0.0::DOUBLE AS total FROM c JOIN r ON r.ts BETWEEN c."at" - INTERVAL 3 DAY AND c."at" + INTERVAL 3 DAY GROUP BY c."at" """),
    "rolling_90d": (rolling_90d, rounding(NATION_DAY + """, m AS (SELECT ts, sum(vol_quote) AS v FROM p GROUP BY ts), k AS (SELECT *, CAST(floor(epoch(ts - (SELECT min(ts) FROM m)) / (90 * 86400)) AS BIGINT) AS w FROM m), z AS (SELECT w AS "window", count(*) AS n, min(ts) AS "from", sum(v) AS total FROM k GROUP BY w)""", "total", '"window", n, "from"', 2)),
    "array_parts": (array_parts, "WITH " + NATION_MONTH.strip() + " SELECT ts, ntile(7) OVER (ORDER BY ts) AS part FROM (SELECT DISTINCT ts FROM p)"),
    "upsert_keep_last": (upsert_keep_last, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus FROM orders"),
    "set_ops": (set_ops, """WITH a AS (SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer), b AS (SELECT CAST(s_nationkey AS BIGINT) AS k FROM supplier WHERE s_suppkey % 4 <> 0)
      SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'minus', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)"""),
    "first_of_key": (first_of_key, "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1"),
    "json_props": (json_props, "SELECT event_type, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k, count(*) FILTER (WHERE props->>'$.k' IS NULL) AS n_null, round(avg(value), 6) AS mean FROM events GROUP BY event_type"),
    "array_embeddings": (array_embeddings, "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(list_max(embedding)::DOUBLE, 5) AS top FROM embeddings"),
    "string_similarity": (string_similarity, """WITH n AS (SELECT n_nationkey AS i, lower(n_name) AS a, n_regionkey AS g FROM nation) SELECT x.i, y.i AS j, levenshtein(x.a, y.a) AS edits, round(1 - levenshtein(x.a, y.a) / greatest(length(x.a), length(y.a), 1)::DOUBLE, 6) AS similarity, 1 - levenshtein(x.a, y.a) / greatest(length(x.a), length(y.a), 1)::DOUBLE > 0.85 AS crowded FROM n x JOIN n y ON x.g = y.g AND x.i < y.i"""),
    "hash_rows": (hash_rows, "SELECT s_suppkey, sha256(concat_ws('|', coalesce(s_suppkey::VARCHAR, ''), coalesce(s_name, ''), coalesce(s_nationkey::VARCHAR, ''))) AS sha FROM supplier"),
    "calendar_months": (calendar_months, "WITH o AS (SELECT date_trunc('month', o_orderdate)::DATE AS month FROM orders), s AS (SELECT unnest(generate_series((SELECT min(month) FROM o)::TIMESTAMP, (SELECT max(month) FROM o)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month) SELECT s.month, count(o.month) AS n FROM s LEFT JOIN o ON s.month = o.month GROUP BY s.month"),
    "classify_expressions": (classify_expressions, "SELECT * FROM (VALUES (0::BIGINT, 'momentum'), (1::BIGINT, 'momentum'), (2::BIGINT, 'volume'), (3::BIGINT, 'other'), (4::BIGINT, 'momentum'), (5::BIGINT, 'volume')) t(id, family)"),
    "lot_rounding": (lot_rounding, """WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity * 0.01::DOUBLE AS unit, l_quantity * 37.0::DOUBLE AS want FROM lineitem), r AS (SELECT *, round_even(want / unit, 0) AS lots FROM l)
      SELECT l_orderkey, l_linenumber, lots, round(abs(greatest(lots, 1) * unit / want - 1), 6) AS error FROM r"""),
    "book_sweep": (book_sweep, rounding(_BOOK + f""", g AS (SELECT l_orderkey, max(bid) AS bid, max(ask) AS ask, max(mid) AS mid, {_sweep_cols()} FROM c GROUP BY l_orderkey),
      z AS (SELECT *, (ask - bid) / mid * 1e4 AS spread_bp, (bid_depth_5 - ask_depth_5) / nullif(bid_depth_5 + ask_depth_5, 0) AS imbalance_5, (bid_depth_25 - ask_depth_25) / nullif(bid_depth_25 + ask_depth_25, 0) AS imbalance_25 FROM g)""", _BOOK_D, "l_orderkey", 8)),
    "ema_pack": (ema_pack, "WITH RECURSIVE " + EVENT_HOURS.strip() + f""", r AS (SELECT asset, ts, close, row_number() OVER ({W}) AS i FROM p),
      e(asset, ts, i, y, w) AS (SELECT asset, ts, i, close, CASE WHEN close IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END FROM r WHERE i = 1
        UNION ALL SELECT r.asset, r.ts, r.i, CASE WHEN r.close IS NULL THEN e.y WHEN e.y IS NULL THEN r.close ELSE (e.w * (11.0::DOUBLE / 13) * e.y + (2.0::DOUBLE / 13) * r.close) / (e.w * (11.0::DOUBLE / 13) + 2.0::DOUBLE / 13) END, CASE WHEN r.close IS NULL THEN e.w * (11.0::DOUBLE / 13) ELSE 1.0::DOUBLE END FROM e JOIN r ON r.asset = e.asset AND r.i = e.i + 1)
      SELECT asset, ts, round(y, 6) + 0.0::DOUBLE AS ema12 FROM e"""),
    "rsi_atr_adx": (rsi_atr_adx, rounding("RECURSIVE " + EVENT_HOURS.strip() + f""", b AS (SELECT *, lag(close) OVER ({W}) AS pc, lag(high) OVER ({W}) AS ph, lag(low) OVER ({W}) AS pl FROM bars),
      i AS (SELECT asset, ts, close, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss,
        CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS up, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS down FROM b),
      {ema_cte("e", "i", {"gain": ("gain", 14), "loss": ("loss", 14), "atr": ("tr", 14), "up": ("up", 14), "down": ("down", 14), "mid": ("close", 20), "wide": ("tr", 20)})},
      k AS (SELECT *, 100 * up / nullif(atr, 0) AS plus_di, 100 * down / nullif(atr, 0) AS minus_di, CASE WHEN loss <> 0 THEN 100 - 100 / (1 + gain / loss) END AS rsi, CASE WHEN count(atr) OVER v >= 20 THEN atr / avg(atr) OVER v END AS atr_ratio FROM e WINDOW v AS ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
      n AS (SELECT asset, ts, CASE WHEN plus_di + minus_di <> 0 THEN 100 * abs(plus_di - minus_di) / (plus_di + minus_di) END AS dx FROM k), {ema_cte("x", "n", {"adx": ("dx", 14)})},
      bb AS (SELECT asset, ts, CASE WHEN count(close) OVER v >= 20 THEN avg(close) OVER v END AS m, stddev_pop(close) OVER v AS sd FROM i WINDOW v AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
      z AS (SELECT asset, ts, rsi, atr, atr_ratio, plus_di, minus_di, adx, CASE WHEN coalesce(adx, 0) > 25 AND atr_ratio > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS trend,
        CASE WHEN m + 2 * sd < mid + 1.5 * wide AND m - 2 * sd > mid - 1.5 * wide THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS squeeze FROM k JOIN x USING (asset, ts) JOIN bb USING (asset, ts))""", "rsi, atr, atr_ratio, plus_di, minus_di, adx, trend, squeeze", "asset, ts")),
    "market_cap_scope": (market_cap_scope, "WITH " + NATION_MONTH.strip() + " SELECT asset, ts, coalesce(close IS NOT NULL AND vol_quote >= quantile_cont(CASE WHEN close IS NOT NULL THEN vol_quote END, 0.5) OVER (PARTITION BY ts), false) AS large FROM p"),
}
