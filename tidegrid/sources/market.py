"""Readers of market tables: declared schemas, typed projections, paged and zipped sources."""

from __future__ import annotations

import io
import json
import tarfile
import time
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.upsert import keep_first

BARS = "asset string, ts timestamp, open double, high double, low double, close double, volume double, vol_quote double"
FUNDING = "asset string, ts timestamp, funding_rate double"
OPEN_INTEREST = "asset string, ts timestamp, open_interest_contracts double, open_interest_ccy double, open_interest_usd double"
MARKET_CAP = "asset string, ts timestamp, market_cap_usd double"
BOOK_MESSAGE = "instId string, ts string, action string, bids array<array<string>>, asks array<array<string>>"
TRADES = "instrument_name string, created_time long, trade_id string, side string, price double, size double"
#: Attributes of an instrument as it is sent, and their names here (fixed values).
INSTRUMENT = {
    "instId": "inst_id", "instType": "inst_type", "uly": "underlying", "baseCcy": "base_ccy", "quoteCcy": "quote_ccy", "settleCcy": "settle_ccy",
    "ctVal": "contract_value", "ctValCcy": "contract_value_ccy", "lotSz": "lot_size", "minSz": "minimum_size", "tickSz": "tick_size", "state": "state",
}


def number(x: Column | str) -> Column:
    """A double, or NULL for text that is none, NaN or infinite."""
    d = (F.col(x) if isinstance(x, str) else x).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def millis(x: Column | str) -> Column:
    return F.timestamp_millis((F.col(x) if isinstance(x, str) else x).try_cast("long"))


def spot_id(inst: Column) -> Column:
    """The spot instrument of a swap."""
    return F.regexp_replace(inst, "-SWAP$", "")


def asset_alias(inst: Column) -> Column:
    return F.lower(F.split_part(inst, F.lit("-"), F.lit(1)))


def candles(raw: DataFrame, array: str = "row") -> DataFrame:
    """Bars from arrays [ms, o, h, l, c, vol, vol_ccy, vol_quote, confirm]; later duplicates of (asset, ts) go."""
    at = lambda i: F.get(F.col(array), i)
    out = raw.select("asset", millis(at(0)).alias("ts"), *[number(at(i)).alias(n) for i, n in ((1, "open"), (2, "high"), (3, "low"), (4, "close"), (5, "volume"), (7, "vol_quote"))], (F.coalesce(at(8), F.lit("1")) == "1").alias("confirmed"))
    return out.where("ts IS NOT NULL")


def confirmed(bars: DataFrame) -> DataFrame:
    return bars.where("confirmed").drop("confirmed")


def funding(raw: DataFrame) -> DataFrame:
    """The realised rate where there is one, else the announced one; first of equal times."""
    out = raw.select("asset", millis("fundingTime").alias("ts"), F.coalesce(number("realizedRate"), number("fundingRate")).alias("funding_rate"))
    return keep_first(out.where("ts IS NOT NULL"), ["asset", "ts"], ["funding_rate"])


def instruments(raw: DataFrame) -> DataFrame:
    """One row an instrument; attributes that are not sent are NULL."""
    out = raw.select(*[(F.col(k) if k in raw.columns else F.lit(None).cast("string")).alias(v) for k, v in INSTRUMENT.items()], (F.col("listTime") if "listTime" in raw.columns else F.lit(None)).try_cast("long").alias("list_time_ms"))
    out = out.withColumn("list_time", F.timestamp_millis("list_time_ms"))
    return keep_first(out, ["inst_id"], ["list_time_ms"])


def open_interest(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """From JSON objects with names or arrays without: [ms, contracts, ccy, usd]."""
    o = F.from_json(payload, "ts string, oi string, oiCcy string, oiUsd string")
    a = F.from_json(payload, "array<string>")
    pick = lambda name, i: F.coalesce(o[name], F.get(a, i))
    out = raw.select("asset", millis(pick("ts", 0)).alias("ts"), number(pick("oi", 1)).alias("open_interest_contracts"), number(pick("oiCcy", 2)).alias("open_interest_ccy"), number(pick("oiUsd", 3)).alias("open_interest_usd"))
    return out.where("ts IS NOT NULL")


def market_cap(raw: DataFrame) -> DataFrame:
    out = raw.select("asset", F.to_timestamp("time").alias("ts"), number("CapMrktCurUSD").alias("market_cap_usd")).na.drop()
    return keep_first(out, ["asset", "ts"], ["market_cap_usd"])


def archive_links(ids: DataFrame, start: str, end: str, link: Callable[[Column, Column], Column]) -> DataFrame:
    """One link an instrument and month, each once."""
    months = ids.select("inst_id", F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("month"))
    return months.withColumn("url", link(F.col("inst_id"), F.col("month"))).dropDuplicates(["url"])


def read_bars(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """Bars with a declared schema; the time bounds reach the Parquet scan."""
    d = spark.read.schema(BARS).parquet(path)
    if since is not None:
        d = d.where(F.col("ts") >= F.lit(since))
    return d.where(F.col("ts") <= F.lit(until)) if until is not None else d


def require_history(df: DataFrame, start, slack_days: int = 7) -> DataFrame:
    """Assets whose first row is more than the slack after ``start``; an empty result is good."""
    late = F.min("ts") > F.lit(start) + F.make_dt_interval(F.lit(slack_days))
    return df.groupBy("asset").agg(F.min("ts").alias("first"), late.alias("late")).where("late").drop("late")


def missing_assets(wanted: DataFrame, *tables: tuple[str, DataFrame]) -> DataFrame:
    """Wanted assets without rows, by table."""
    out = None
    for name, t in tables:
        gone = wanted.join(t.select("asset").distinct(), "asset", "left_anti").select("asset", F.lit(name).alias("table"))
        out = gone if out is None else out.unionByName(gone)
    return out


def read_ledger(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; a bad line fails the query, or is dropped if not ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def synthetic_panel(spark: SparkSession, assets: int, rows: int, seed: int = 0) -> DataFrame:
    """Random walks by asset; the noise depends on the seed and row only."""
    d = spark.range(assets * rows).select((F.col("id") % assets).alias("a"), F.floor(F.col("id") / assets).alias("i"))
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "a", "i"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    noise = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * 3.141592653589793 * u(2))
    from ..functions.numeric import asset_time

    d = d.select(F.concat(F.lit("A"), F.lpad(F.col("a").cast("string"), 4, "0")).alias("asset"), F.timestamp_seconds(F.lit(1704067200) + F.col("i") * 3600).alias("ts"), (noise * 0.01).alias("step"), (u(3) * 1e6).alias("vol_quote"))
    return d.withColumn("close", 100 * F.exp(F.sum("step").over(asset_time()))).drop("step")


def _files(uri: str) -> list[str]:
    fs, path = _fs(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [uri]
    scheme = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    return sorted(scheme + f.path for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.type == pafs.FileType.File)


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (pafs.LocalFileSystem(), uri)


class Part(InputPartition):
    def __init__(self, value):
        self.value = value


class _Archives(DataSourceReader):
    """One partition an archive; members are streamed, not unpacked."""

    def __init__(self, options: dict, schema: StructType, lines: Callable[[str], Iterator[tuple]]):
        self.uris, self.lines = [u for p in options["path"].split(",") for u in _files(p)], lines

    def partitions(self) -> list[Part]:
        return [Part(u) for u in self.uris]

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.lines(partition.value)


def _zip_lines(uri: str) -> Iterator[tuple]:
    fs, path = _fs(uri)
    with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        for name in z.namelist():
            if name.endswith(".csv"):
                with z.open(name) as m:
                    for n, line in enumerate(io.TextIOWrapper(m, encoding="utf-8")):
                        if line.strip():
                            yield uri, name, n, line.rstrip("\r\n")


def _tar_lines(uri: str) -> Iterator[tuple]:
    fs, path = _fs(uri)
    found = 0
    with fs.open_input_stream(path, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as t:
        for m in t:
            if not m.isfile() or not m.name.endswith(".data"):
                continue
            found += 1
            if found > 1:
                raise ValueError(f"{uri} has more than one data member")
            for n, line in enumerate(t.extractfile(m)):
                if line.strip():
                    yield uri, m.name, n, line.decode().rstrip("\r\n")
    if not found:
        raise ValueError(f"{uri} has no data member")


class ZipLines(DataSource):
    """Lines of the CSV members of ZIP archives."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "archive string, member string, line long, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Archives(self.options, schema, _zip_lines)


class TarLines(ZipLines):
    """Lines of the one data member of each tar archive."""

    @classmethod
    def name(cls) -> str:
        return "tar_lines"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Archives(self.options, schema, _tar_lines)


def read_zipped_csv(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """CSV members with a header line each, typed, later lines of equal keys winning."""
    spark.dataSource.register(ZipLines)
    lines = spark.read.format("zip_lines").option("path", path).load().where("line > 0")
    d = lines.select("archive", "member", "line", F.from_csv("value", schema).alias("r")).select("r.*", "archive", "member", "line")
    from ..operators.upsert import keep_last

    return keep_last(d, keys=keys, order=["archive", "member", "line"]).drop("archive", "member", "line")


def read_trades(spark: SparkSession, path: str, inst: str, start_ms: int, end_ms: int) -> DataFrame:
    d = read_zipped_csv(spark, path, TRADES, ["created_time", "trade_id"])
    return d.where((F.col("instrument_name") == inst) & (F.col("created_time") >= start_ms) & (F.col("created_time") < end_ms))


def read_book_messages(spark: SparkSession, path: str) -> DataFrame:
    """Order-book messages in archive order: (inst, ts_ms, seq, action, bids, asks)."""
    spark.dataSource.register(TarLines)
    lines = spark.read.format("tar_lines").option("path", path).load()
    m = F.from_json("value", BOOK_MESSAGE)
    level = lambda a: F.transform(a, lambda x: F.struct(x[0].cast("double").alias("price"), x[1].cast("double").alias("size")))
    return lines.select(m["instId"].alias("inst"), m["ts"].cast("long").alias("ts_ms"), F.col("line").alias("seq"), m["action"].alias("action"), level(m["bids"]).alias("bids"), level(m["asks"]).alias("asks"))


class ServiceError(RuntimeError):
    """A service's answer with a status; 429 and 5xx may pass."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"{status} {message}".strip())
        self.status = status

    def __reduce__(self):
        return ServiceError, (self.status, str(self).partition(" ")[2])


def passing(error: Exception) -> bool:
    """Whether an error may pass: a lost connection, too many calls, or a fault of the service."""
    if isinstance(error, ServiceError):
        return error.status == 429 or 500 <= error.status < 600
    return isinstance(error, OSError | TimeoutError)


def with_retries(call: Callable[[], object], attempts: int = 5, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """Calls again after errors that may pass, waiting twice as long each time."""
    for i in range(attempts):
        try:
            return call()
        except Exception as error:
            if i == attempts - 1 or not passing(error):
                raise
            sleep(wait * 2**i)


class CursorReader(DataSourceReader):
    """One partition a key; its pages follow each other by cursor until there is none, or one comes again."""

    def __init__(self, options: dict, fetch: Callable[[str, str | None], tuple[list[dict], str | None]]):
        self.keys, self.fetch, self.wait = options["keys"].split(","), fetch, float(options.get("wait", 0.5))

    def partitions(self) -> list[Part]:
        return [Part((k,)) for k in self.keys]

    def read(self, partition: Part) -> Iterator[tuple]:
        (key,), cursor, page, seen = partition.value, None, 0, set()
        while True:
            rows, cursor = with_retries(lambda: self.fetch(key, cursor), wait=self.wait)  # noqa: B023
            for row in rows:
                yield key, page, json.dumps(row, sort_keys=True)
            page += 1
            if cursor is None or cursor in seen:
                return
            seen.add(cursor)


def cursor_source(source: str, fetch: Callable[[str, str | None], tuple[list[dict], str | None]]) -> type[DataSource]:
    """A data source over a service that pages by cursor (before, after or a token): ``fetch(key, cursor)`` gives rows and the next cursor."""

    class Cursored(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> str:
            return "asset string, page int, payload string"

        def reader(self, schema: StructType) -> DataSourceReader:
            return CursorReader(self.options, fetch)

    return Cursored


def write_zipped_csv(df: DataFrame, directory: str) -> DataFrame:
    """Each partition's rows as one CSV member, with a header line, of a new ZIP file; returns the files that finished tasks wrote."""
    names = df.columns

    def work(frames):
        import csv
        import io
        import uuid
        import zipfile

        import pandas as pd

        text = io.StringIO()
        out, n = csv.writer(text), 0
        out.writerow(names)
        for pdf in frames:
            for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                out.writerow(row)
                n += 1
        if n:
            fs, root = _fs(directory)
            fs.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(f"{root}/{name}") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("rows.csv", text.getvalue())
            yield pd.DataFrame([(f"{directory}/{name}", n)], columns=["path", "n"])

    return df.mapInPandas(work, "path string, n long")


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[str, int], list[dict]]):
        self.keys, self.pages, self.fetch = options["keys"].split(","), int(options.get("pages", 1)), fetch

    def partitions(self) -> list[Part]:
        return [Part((k, p)) for k in self.keys for p in range(self.pages)]

    def read(self, partition: Part) -> Iterator[tuple]:
        key, page = partition.value
        for row in with_retries(lambda: self.fetch(key, page)):
            yield key, page, json.dumps(row, sort_keys=True)


def paged_source(source: str, fetch: Callable[[str, int], list[dict]]) -> type[DataSource]:
    """A data source over a paged service: one partition a key and page, rows as JSON.

    ``fetch`` is the caller's client; nothing here opens a connection.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> str:
            return "asset string, page int, payload string"

        def reader(self, schema: StructType) -> DataSourceReader:
            return PagedReader(self.options, fetch)

    return Paged
