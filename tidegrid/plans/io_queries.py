"""Queries of sources, sinks and streams: rows are written to the shared folder, read back and compared with SQL over the tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import market, stores
from ..streaming import incremental
from .panels import EVENT_HOURS, event_hours, rounded, rounding, table


def _ms(ts: str):
    return F.unix_millis(F.col(ts).cast("timestamp")).cast("string")



def candle_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Bars sent as arrays of strings, some with bad numbers, and the last hour of a day not confirmed."""
    s = lambda c: F.col(c).cast("string")
    open_ = F.when(F.hour("ts") == 23, "0").otherwise("1")
    raw = event_hours(spark, sf).select("asset", F.array(_ms("ts"), s("open"), s("high"), s("low"), F.when(F.hour("ts") % 7 == 0, "x").otherwise(s("close")), s("volume"), F.lit("0"), s("vol_quote"), open_).alias("row"))
    return rounded(market.confirmed(market.candles(raw)).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def funding_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Realised rates, else announced ones, by kind and hour; the first of equal times by value."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("asset"), F.unix_millis(F.date_trunc("hour", "ts").cast("timestamp")).cast("string").alias("fundingTime"), F.when(F.col("event_id") % 3 != 0, F.col("value").cast("string")).alias("realizedRate"), F.col("user_id").cast("string").alias("fundingRate"))
    return rounded(market.funding(e).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def open_interest_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Objects with names for even ids, arrays for odd ones."""
    e = table(spark, sf, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")).cast("string"))
    v, u = F.col("value").cast("string"), F.col("user_id").cast("string")
    payload = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("ms").alias("ts"), u.alias("oi"), v.alias("oiUsd")))).otherwise(F.to_json(F.array("ms", u, F.lit("bad"), v)))
    out = market.open_interest(e.select(F.col("event_id").cast("string").alias("asset"), payload.alias("payload")))
    return rounded(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def cursor_paging(spark: SparkSession, sf: str) -> DataFrame:
    """Three keys of a service that pages by cursor; each page fails once with a status that passes."""
    def fetch(key: str, cursor: str | None, failed: set = set()) -> tuple[list[dict], str | None]:  # noqa: B006  a worker's memory of its failures
        if (key, cursor) not in failed:
            failed.add((key, cursor))
            raise market.ServiceError(429, "too many calls")
        start = int(cursor or 0)
        rows = [{"i": start + j, "v": (start + j) * len(key)} for j in range(7)]
        return rows, str(start + 7) if start + 7 < 35 else None

    spark.dataSource.register(market.cursor_source("cursor_pages", fetch))
    d = spark.read.format("cursor_pages").option("keys", "a,bb,ccc").option("wait", "0.001").load()
    return d.select("asset", F.col("page").cast("long").alias("page"), F.get_json_object("payload", "$.i").cast("long").alias("i"), F.get_json_object("payload", "$.v").cast("long").alias("v"))


def zip_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as CSV in ZIP files of the shared folder and read back by the archive source; later lines of equal keys win."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))
    folder = shared_dir(spark, "zip")
    written = market.write_zipped_csv(e, folder).agg(F.sum("n")).first()[0]
    d = market.read_zipped_csv(spark, folder, "event_id long, user_id long, event_type string, value double", ["event_id"])
    return rounded(d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum("user_id").alias("users"))).withColumn("written", F.lit(written).cast("long"))


def store_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Bars in the content-addressed store, loaded by manifest with their fingerprint checked; a second write changes nothing."""
    bars = event_hours(spark, sf)
    store = stores.TableStore(spark, shared_dir(spark, "store"))
    first, second = store.write("bars", {"bars": bars}), store.write("bars", {"bars": bars.repartition(3)})
    return rounded(store.load("bars")["bars"]).withColumn("same", F.lit(first == second))


def cached_result(spark: SparkSession, sf: str) -> DataFrame:
    """A result asked for twice: the second time it comes from the cache."""
    cache, e = stores.ResultCache(spark, shared_dir(spark, "cache")), table(spark, sf, "events")
    build = lambda: e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    request = {"by": "event_type"}
    cache.get(request, ["events"], build)
    got, hit = cache.get(request, ["events"], build)
    return got.withColumn("hit", F.lit(hit))


def upsert_months(spark: SparkSession, sf: str) -> DataFrame:
    """Two upserts of order days: all of them, then the second half of the months with doubled totals; the last of equal keys wins."""
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("asset"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.sum("o_totalprice").alias("total"))
    t = incremental.VersionedTable(spark, shared_dir(spark, "upsert"), ["asset", "ts"])
    t.upsert(o, "v1")
    t.upsert(o.where("ts >= timestamp_ntz'1998-05-01'").withColumn("total", F.col("total") * 2), "v2")
    return rounded(t.read(), 2)


def _event_stream(spark: SparkSession, sf: str, slices: int = 3) -> tuple[DataFrame, Iterator[None]]:
    """The events table as a stream of files, and its arrivals: each step adds the files of the next slice of time.

    A file source takes files by their time of modification, and tasks that
    write side by side end in any order. So a slice arrives only when the
    stream has taken the one before, and no row is late.
    """
    folder = shared_dir(spark, "stream")
    rows = table(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    at = F.unix_micros("ts")
    rows.limit(0).write.parquet(folder)  # a stream's folder has to be there

    def arrivals() -> Iterator[None]:
        bounds = rows.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)])).first()[0] or []
        number = sum((F.coalesce((at >= b).cast("int"), F.lit(0)) for b in bounds), F.lit(0))
        for i in range(slices):
            rows.where(number == i).write.mode("append").parquet(folder)
            yield

    return spark.readStream.schema(rows.schema).parquet(folder), arrivals()


def _drained(spark: SparkSession, df: DataFrame, arrivals: Iterator[None], label: str) -> DataFrame:
    out = shared_dir(spark, label)
    for _ in arrivals:
        df.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Six-hour windows of the event stream that the watermark has closed."""
    events, arrivals = _event_stream(spark, sf)
    closed = incremental.tumbling(events, "ts", "6 hours", "30 minutes", ["event_type"], "value")
    return rounded(_drained(spark, closed, arrivals, "tumbling").withColumn("start", F.col("start").cast("timestamp_ntz")), 4)


def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmed rows of the event stream, upserted batch by batch."""
    t = incremental.VersionedTable(spark, shared_dir(spark, "stream-table"), ["event_type", "event_id"])
    events, arrivals = _event_stream(spark, sf)
    rows, state = events.withColumn("confirmed", F.col("event_id") % 10 != 0), shared_dir(spark, "stream-state")
    for _ in arrivals:
        incremental.stream_upsert(rows, t, state).awaitTermination()
    return rounded(t.read().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


def freshness(spark: SparkSession, sf: str) -> DataFrame:
    """Age of each kind's last event at the end of the table."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("asset"), "ts")
    now = e.agg(F.max("ts")).first()[0]
    return rounded(incremental.freshness(e, now, 0.5))


QUERIES = {
    "candle_projection": (candle_projection, rounding(EVENT_HOURS + """, z AS (SELECT asset, ts, open, high, low, CASE WHEN hour(ts) % 7 <> 0 THEN close END AS close, volume, vol_quote FROM bars WHERE hour(ts) <> 23)""", "open, high, low, close, volume, vol_quote", "asset, ts")),
    "funding_projection": (funding_projection, rounding("""e AS (SELECT event_type AS asset, date_trunc('hour', ts)::TIMESTAMP AS ts, CASE WHEN event_id % 3 <> 0 THEN value ELSE user_id::DOUBLE END AS r FROM events), z AS (SELECT asset, ts, min(r) AS funding_rate FROM e GROUP BY ALL)""", "funding_rate", "asset, ts")),
    "open_interest_projection": (open_interest_projection, rounding("""z AS (SELECT CAST(event_id AS VARCHAR) AS asset, date_trunc('millisecond', ts)::TIMESTAMP AS ts, user_id::DOUBLE AS open_interest_contracts, NULL::DOUBLE AS open_interest_ccy, value AS open_interest_usd FROM events)""", "open_interest_contracts, open_interest_ccy, open_interest_usd", "asset, ts")),
    "cursor_paging": (cursor_paging, "SELECT k AS asset, i // 7 AS page, i, i * len(k) AS v FROM (SELECT unnest(['a', 'bb', 'ccc']) AS k) CROSS JOIN (SELECT unnest(range(0, 35)) AS i)"),
    "zip_roundtrip": (zip_roundtrip, rounding("z AS (SELECT event_type, count(*) AS n, sum(round(value, 6)) AS total, CAST(sum(user_id) AS BIGINT) AS users, (SELECT count(*) FROM events) AS written FROM events GROUP BY ALL)", "total", "event_type, n, users, written")),
    "store_roundtrip": (store_roundtrip, rounding(EVENT_HOURS + ", z AS (SELECT *, true AS same FROM bars)", "open, high, low, close, volume, vol_quote", "asset, ts, same")),
    "cached_result": (cached_result, "SELECT event_type, count(*) AS n, true AS hit FROM events GROUP BY ALL"),
    "upsert_months": (upsert_months, rounding("""m AS (SELECT o_orderpriority AS asset, date_trunc('month', o_orderdate)::TIMESTAMP AS ts, sum(o_totalprice) AS t FROM orders GROUP BY ALL), z AS (SELECT asset, ts, t * CASE WHEN ts >= TIMESTAMP '1998-05-01' THEN 2 ELSE 1 END AS total FROM m)""", "total", "asset, ts", 2)),
    "stream_tumbling": (stream_tumbling, rounding("""w AS (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2020-01-01') AS start, event_type, value FROM events), z AS (SELECT start, event_type, count(*) AS n, sum(value) AS total FROM w GROUP BY ALL HAVING start + INTERVAL '6 hours' <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL '30 minutes')""", "total", "start, event_type, n", 4)),
    "stream_upsert": (stream_upsert, rounding("z AS (SELECT event_type, count(*) AS n, sum(value) AS total FROM events WHERE event_id % 10 <> 0 GROUP BY ALL)", "total", "event_type, n", 4)),
    "freshness": (freshness, rounding("z AS (SELECT event_type AS asset, (epoch(date_trunc('second', (SELECT max(ts) FROM events))) - epoch(date_trunc('second', max(ts)))) / 3600.0::DOUBLE AS age_hours, max(ts) AS last, (epoch(date_trunc('second', (SELECT max(ts) FROM events))) - epoch(date_trunc('second', max(ts)))) / 3600.0::DOUBLE <= 0.5 AS fresh FROM events GROUP BY ALL)", "age_hours", "asset, last, fresh")),
}
