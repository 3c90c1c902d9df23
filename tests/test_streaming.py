import datetime as dt
import json

import pytest

from tidegrid.streaming import book, incremental

LEVELS = "inst string, ts_ms long, seq long, action string, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>"
MESSAGES = [
    ("X", 1000, 0, "snapshot", [(99.0, 1.0), (98.0, 2.0)], [(101.0, 1.0)]),
    ("X", 15000, 1, "update", [(99.0, 0.0)], []),
    ("X", 20000, 2, "update", [], [(100.5, 3.0)]),
    ("X", 19000, 3, "update", [(97.0, 1.0)], []),
    ("X", 31000, 4, "snapshot", [(90.0, 1.0)], [(110.0, 1.0)]),
    ("Y", 5000, 0, "snapshot", [(1.0, 1.0)], [(2.0, 1.0)]),
    ("Y", 12000, 1, "update", [], []),
]


def test_replay(spark):
    d = spark.createDataFrame(MESSAGES, LEVELS)
    got = {(r.inst, r.sample_ms): (r.bid, r.ask, r.late) for r in book.replay(d, 10_000, 60_000).collect()}
    # before the boundary the book is as it was; at the boundary itself with the message
    assert got["X", 10000] == (99.0, 101.0, 0) and got["X", 20000] == (98.0, 100.5, 0)
    assert got["X", 30000] == (98.0, 100.5, 1) and got["X", 40000] == (90.0, 110.0, 1) and got["Y", 50000] == (1.0, 2.0, 0)
    assert len(got) == 10


def _write(path, rows, n):
    names = ["inst", "ts_ms", "seq", "action", "bids", "asks"]
    level = lambda x: [{"price": p, "size": s} for p, s in x]
    text = "\n".join(json.dumps(dict(zip(names, [*r[:4], level(r[4]), level(r[5])], strict=True))) for r in rows)
    (path / f"{n}.json").write_text(text)


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _write(src, MESSAGES[:2] + MESSAGES[5:6], 0)
    stream = spark.readStream.schema(LEVELS).option("maxFilesPerTrigger", 1).json(str(src))
    run = lambda: book.stream_samples(stream).writeStream.format("memory").queryName("samples").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True)
    q = run().start()
    q.awaitTermination()
    first = {(r.inst, r.sample_ms): (r.bid, r.ask) for r in spark.sql("SELECT * FROM samples").collect()}
    assert first == {("X", 10000): (99.0, 101.0)}
    batch = {(r.inst, r.sample_ms): (r.bid, r.ask) for r in book.replay(spark.createDataFrame(MESSAGES, LEVELS), 10_000, 40_000).collect()}
    _write(src, MESSAGES[2:5] + MESSAGES[6:], 1)
    q = book.stream_samples(stream).writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.inst, r.sample_ms): (r.bid, r.ask) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and all(batch[k] == v for k, v in got.items())


def test_effective_spread(spark):
    samples = book.replay(spark.createDataFrame(MESSAGES, LEVELS), 10_000, 60_000)
    trades = spark.createDataFrame([("X", 25_000, "buy", 100.0), ("X", 10_000, "sell", 99.0)], "inst string, ts long, side string, price double")
    got = {r.ts: (r.mid, r.effective_bp, r.quote_age_ms) for r in book.effective_spread(trades, samples).collect()}
    assert got[25_000] == (99.25, pytest.approx(2 * 0.75 / 99.25 * 1e4), 5000) and got[10_000][0] is None


def test_stream_upsert(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    table = incremental.VersionedTable(spark, str(tmp_path / "t"), ["asset", "ts"])
    row = lambda a, d, v, c: json.dumps({"asset": a, "ts": f"2024-{d}T00:00:00Z", "close": v, "confirmed": c})
    (src / "0.json").write_text("\n".join([row("a", "01-01", 1, True), row("a", "02-01", 2, True), row("a", "02-02", 9, False)]))
    rows = spark.readStream.schema("asset string, ts timestamp, close double, confirmed boolean").json(str(src))
    incremental.stream_upsert(rows, table, str(tmp_path / "c")).awaitTermination()
    (src / "1.json").write_text("\n".join([row("a", "02-01", 5, True), row("b", "02-01", 3, True)]))
    incremental.stream_upsert(rows, table, str(tmp_path / "c")).awaitTermination()
    got = {(r.asset, r.ts.month): r.close for r in table.read().collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 5.0, ("b", 2): 3.0}


def test_windows_and_trader(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [{"asset": "a", "ts": f"2024-01-01T00:0{i}:00Z", "close": 100.0 + i, "target": 1.0} for i in range(6)] + [{"asset": "a", "ts": "2024-01-01T02:00:00Z", "close": 100.0, "target": 0.0}]
    (src / "0.json").write_text("\n".join(map(json.dumps, lines)))
    rows = spark.readStream.schema("asset string, ts timestamp, close double, target double").json(str(src))
    out = []
    q = incremental.tumbling(rows, "ts", "5 minutes", "1 minute", ["asset"], "close").writeStream.foreachBatch(lambda d, n: out.extend(d.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.total) for r in sorted(out, key=lambda r: r.start)][:1] == [(5, 510.0)]
    out.clear()
    q = incremental.paper_trades(rows, 1000.0, 0.0).writeStream.foreachBatch(lambda d, n: out.extend(d.collect())).option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(r.capital for r in out) == pytest.approx(1050.0)
    fresh = incremental.freshness(spark.createDataFrame([("a", dt.datetime(2024, 1, 1))], "asset string, ts timestamp"), dt.datetime(2024, 1, 1, 4)).first()
    assert fresh.age_hours == 4 and not fresh.fresh
