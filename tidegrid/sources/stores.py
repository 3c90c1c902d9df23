"""Sinks that never overwrite: content-addressed tables, cached results, immutable records."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .market import _fs


class IntegrityError(RuntimeError):
    """What is stored is not what was written."""


def canonical(value: object) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value)).hexdigest()


def fingerprint(df: DataFrame) -> str:
    """An order-free digest of schema and rows; two aggregates come to the driver."""
    h = F.xxhash64(*df.columns) if df.columns else F.lit(0).cast("long")
    n, x, s = df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.shiftright(h, 20)), F.lit(0))).first()
    return digest([df.schema.simpleString(), n, x, s])


def _read(uri: str) -> bytes | None:
    fs, path = _fs(uri)
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(path) as f:
        return f.read()


def write_once(uri: str, value: object) -> bool:
    """Writes a record that does not exist yet; an equal one is fine, another is an error."""
    data, old = canonical(value), _read(uri)
    if old is not None:
        if old != data:
            raise IntegrityError(f"{uri} holds another record")
        return False
    fs, path = _fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(data)
    return True


def append_lines(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    df.write.mode("append").json(path)


class TableStore:
    """Tables under their fingerprints, named by immutable manifests."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, name: str, tables: dict[str, DataFrame]) -> dict:
        parts = {}
        for table, df in sorted(tables.items()):
            key = fingerprint(df)
            path = f"{self.root}/objects/{key}"
            if _read(f"{path}/_SUCCESS") is None:
                df.write.mode("overwrite").parquet(path)
            parts[table] = {"key": key, "schema": df.schema.simpleString()}
        manifest = {"name": name, "tables": parts}
        write_once(f"{self.root}/manifests/{name}.json", manifest)
        return manifest

    def load(self, name: str) -> dict[str, DataFrame]:
        """The tables of a manifest, each checked against its fingerprint."""
        raw = _read(f"{self.root}/manifests/{name}.json")
        if raw is None:
            raise FileNotFoundError(name)
        out = {}
        for table, part in json.loads(raw)["tables"].items():
            df = self.spark.read.parquet(f"{self.root}/objects/{part['key']}")
            if fingerprint(df) != part["key"]:
                raise IntegrityError(f"{table} of {name} was changed")
            out[table] = df
        return out


class ResultCache:
    """Results by a digest of what was asked and of the inputs."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = TableStore(spark, root)

    def get(self, request: dict, inputs: list[str], build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        key = digest([request, sorted(inputs)])
        try:
            return self.store.load(key)["result"], True
        except FileNotFoundError:
            self.store.write(key, {"result": build()})
            return self.store.load(key)["result"], False


def snapshot(df: DataFrame, root: str, day: str) -> bool:
    """A day's rows, written once; running again must give the same rows.

    Returns whether it was written now. The manifest comes last, so a broken
    run leaves no snapshot behind.
    """
    key = fingerprint(df)
    uri = f"{root.rstrip('/')}/manifest/{day}.json"
    old = _read(uri)
    if old is not None:
        if json.loads(old)["key"] != key:
            raise IntegrityError(f"the snapshot of {day} differs")
        return False
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/day={day}")
    return write_once(uri, {"day": day, "key": key})


def to_markdown(df: DataFrame, title: str, limit: int = 100) -> str:
    """A small report table as text."""
    rows = df.limit(limit).collect()
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(map(show, r)) + " |" for r in rows]) + "\n"
