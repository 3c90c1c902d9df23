import datetime as dt
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tidegrid.sources import market, stores


def test_candles_and_funding(spark):
    raw = spark.createDataFrame([("a", ["1704067200000", "1", "2", "0.5", "x", "9", "8", "7", "1"]), ("a", ["1704070800000", "1", "2", "1", "1.5", "9", "8", "7", "0"]), ("a", ["bad"])], "asset string, row array<string>")
    out = market.candles(raw).orderBy("ts").collect()
    assert len(out) == 2 and out[0].close is None and out[0].vol_quote == 7.0 and [r.confirmed for r in out] == [True, False]
    assert market.confirmed(market.candles(raw)).count() == 1
    f = spark.createDataFrame([("a", "1704067200000", "0.1", "0.2"), ("a", "1704067200000", "0.3", "0.4"), ("a", "1704070800000", None, "0.5")], "asset string, fundingTime string, realizedRate string, fundingRate string")
    assert [r.funding_rate for r in market.funding(f).orderBy("ts").collect()] == [0.1, 0.5]


def test_open_interest_forms(spark):
    raw = spark.createDataFrame([("a", json.dumps({"ts": "1", "oi": "2", "oiCcy": "3", "oiUsd": "4"})), ("a", json.dumps(["5", "6", "7", "NaN"]))], "asset string, payload string")
    assert [(r.open_interest_contracts, r.open_interest_usd) for r in market.open_interest(raw).orderBy("ts").collect()] == [(2.0, 4.0), (6.0, None)]


def test_ids_and_instruments(spark):
    d = spark.createDataFrame([("BTC-USDT-SWAP", "5"), ("BTC-USDT-SWAP", "4")], "instId string, listTime string")
    r = market.instruments(d).collect()
    assert len(r) == 1 and r[0].list_time_ms == 4 and r[0].tick_size is None
    assert d.select(market.spot_id(F.col("instId")), market.asset_alias(F.col("instId"))).first() == ("BTC-USDT", "btc")


def test_zip_and_tar(spark, tmp_path):
    for n, rows in (("a", ["X,1,t1,buy,2.5,1", "X,2,t2,sell,3,1"]), ("b", ["X,2,t2,sell,4,1", "Y,3,t3,buy,1,1", "X,9,t4,buy,1,1"])):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            z.writestr(f"{n}.csv", "\n".join(["instrument_name,created_time,trade_id,side,price,size", *rows]))
    t = market.read_trades(spark, str(tmp_path), "X", 1, 9).orderBy("created_time").collect()
    assert [(r.trade_id, r.price) for r in t] == [("t1", 2.5), ("t2", 4.0)]
    folder = tmp_path / "tar"
    folder.mkdir()
    lines = [json.dumps({"instId": "X", "ts": "5", "action": "snapshot", "bids": [["1", "2", "0"]], "asks": []}), json.dumps({"instId": "X", "ts": 6, "action": "update", "bids": [], "asks": [["3", "4"]]})]
    with tarfile.open(folder / "x.tar.gz", "w:gz") as tar:
        data = "\n".join(lines).encode()
        info = tarfile.TarInfo("x.data")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    m = market.read_book_messages(spark, str(folder)).orderBy("seq").collect()
    assert [(r.ts_ms, r.seq) for r in m] == [(5, 0), (6, 1)] and m[0].bids[0].size == 2.0
    with tarfile.open(folder / "y.tar.gz", "w:gz") as tar:
        tar.addfile(tarfile.TarInfo("none.txt"), io.BytesIO(b""))
    with pytest.raises(Exception, match="no data member"):
        market.read_book_messages(spark, str(folder)).count()


def test_paged_source_and_retries(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert market.with_retries(flaky, sleep=lambda s: None) == 7
    spark.dataSource.register(market.paged_source("toy_pages", lambda key, page: [{"k": key, "p": page}]))
    d = spark.read.format("toy_pages").option("keys", "a,b").option("pages", "2").load()
    assert d.count() == 4 and d.where("asset = 'a'").selectExpr("max(get_json_object(payload, '$.p'))").first()[0] == "1"


def test_ledger_modes(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    assert market.read_ledger(spark, str(tmp_path), "a long", strict=False).count() == 2
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        market.read_ledger(spark, str(tmp_path), "a long").collect()


def test_store_detects_change(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id * 2 as v")
    store = stores.TableStore(spark, str(tmp_path))
    m = store.write("one", {"t": df})
    assert store.load("one")["t"].count() == 10
    assert store.write("one", {"t": df.repartition(3)}) == m  # order and partitions don't matter
    with pytest.raises(stores.IntegrityError):
        store.write("one", {"t": df.limit(9)})
    spark.range(3).selectExpr("id", "id * 2 as v").write.mode("overwrite").parquet(f"{tmp_path}/objects/{m['tables']['t']['key']}")
    with pytest.raises(stores.IntegrityError):
        store.load("one")


def test_cache_and_snapshot(spark, tmp_path):
    cache, built = stores.ResultCache(spark, str(tmp_path / "c")), []

    def build():
        built.append(1)
        return spark.range(4)

    assert [cache.get({"q": 1}, ["x"], build)[1] for _ in range(2)] == [False, True] and len(built) == 1
    assert stores.snapshot(spark.range(5), str(tmp_path / "s"), "2024-01-01")
    assert not stores.snapshot(spark.range(5), str(tmp_path / "s"), "2024-01-01")
    with pytest.raises(stores.IntegrityError):
        stores.snapshot(spark.range(6), str(tmp_path / "s"), "2024-01-01")


def test_history_and_missing(spark):
    d = spark.createDataFrame([("a", dt.datetime(2024, 1, 2)), ("b", dt.datetime(2024, 2, 1))], "asset string, ts timestamp")
    assert [r.asset for r in market.require_history(d, dt.datetime(2024, 1, 1)).collect()] == ["b"]
    wanted = spark.createDataFrame([("a",), ("c",)], "asset string")
    assert [tuple(r) for r in market.missing_assets(wanted, ("bars", d)).collect()] == [("c", "bars")]
    s = market.synthetic_panel(spark, 3, 5)
    assert s.count() == 15 and s.exceptAll(market.synthetic_panel(spark, 3, 5)).count() == 0


def test_cursor_source_and_statuses(spark):
    calls = []

    def once():
        calls.append(1)
        raise market.ServiceError(404)

    with pytest.raises(market.ServiceError):
        market.with_retries(once, sleep=lambda s: None)
    assert len(calls) == 1 and market.passing(market.ServiceError(503)) and market.passing(market.ServiceError(429)) and not market.passing(market.ServiceError(400))
    waits = []
    with pytest.raises(TimeoutError):
        market.with_retries(lambda: (_ for _ in ()).throw(TimeoutError()), attempts=4, wait=1, sleep=waits.append)
    assert waits == [1, 2, 4]
    # A service that gives the same cursor for ever is left after it comes again.
    spark.dataSource.register(market.cursor_source("looping", lambda key, cursor: ([{"k": key}], "again")))
    assert spark.read.format("looping").option("keys", "a").load().count() == 2
