"""Helpers shared by the corpus operators: text normalisation, materialising, batching."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one numpy step works on.
BLOCK_BYTES = 2 << 20
#: Rows of one Arrow batch between the JVM and Python; keeps batches of long texts small.
BATCH_ROWS = 256


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Null stays null.

    ``lower`` equals this for pure ASCII; other texts with a capital go
    through ``translate``, the rest are returned as they are.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).when(text.rlike("[A-Z]"), F.translate(text, UPPER, LOWER)).otherwise(text)


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share.

    The cluster's ``spark.checkpoint.dir`` if set; else, as in local tests, a
    temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidegrid-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidegrid/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidegrid_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; nothing may read it any more."""
    path = getattr(df, "_tidegrid_path", None)
    if path:
        spark = df.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that batches of long texts fit in a worker; send the package along."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` bytes of text each, and the texts (null: empty)."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def byte_class(pattern_bytes: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(pattern_bytes)] = True
    return table


#: Space and \t \n \v \f \r: what ``[^\x20\x09-\x0D]+`` leaves out.
SPACE = byte_class([0x20, *range(0x09, 0x0E)])
#: a-z for A-Z, every other byte itself.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def runs(texts: list[bytes], separator: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of non-separator bytes in each text.

    Returns the joined buffer (texts parted by a space, 32 zero bytes at the
    end), starts and ends of the runs in it, and for each text the number of
    its first run, with the total at the end.
    """
    joined = b" ".join(texts) + b" "
    buf = np.frombuffer(joined + b"\0" * 32, dtype=np.uint8)
    if fold:
        buf = FOLD[buf]
    word = np.zeros(len(joined) + 1, dtype=bool)
    word[1:] = ~separator[buf[: len(joined)]]
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[0::2], edge[1::2]
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    first = np.concatenate([[0], np.cumsum(lens + 1)])
    return buf, starts, ends, np.searchsorted(starts, first)


def text_starts(texts: list[bytes]) -> np.ndarray:
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    return np.concatenate([[0], np.cumsum(lens + 1)])[:-1]


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of one buffer (which has 32 spare bytes at its end)."""
    n = len(buf)
    w8 = np.ndarray((n - 7,), dtype="<u8", buffer=buf, strides=(1,))
    w4 = np.ndarray((n - 3,), dtype="<u4", buffer=buf, strides=(1,))
    s = np.uint64(seed)
    pos, length = starts.astype(np.int64), (ends - starts).astype(np.int64)
    h = np.full(len(pos), s + _P5, dtype=np.uint64)
    with np.errstate(over="ignore"):
        long = np.flatnonzero(length >= 32)
        if len(long):
            acc = [np.full(len(long), v, dtype=np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            p, stripes = pos[long].copy(), length[long] // 32
            live = np.arange(len(long))
            while len(live):
                for k in range(4):
                    acc[k][live] = _rot(acc[k][live] + w8[p[live] + 8 * k] * _P2, 31) * _P1
                p[live] += 32
                stripes[live] -= 1
                live = live[stripes[live] > 0]
            merged = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for k in range(4):
                merged = (merged ^ (_rot(acc[k] * _P2, 31) * _P1)) * _P1 + _P4
            h[long] = merged
            pos[long] = p
        h += length.astype(np.uint64)
        rest = length % 32
        for j in range(3):
            at = np.flatnonzero(rest >= 8 * (j + 1))
            if not len(at):
                break
            k = _rot(w8[pos[at] + 8 * j] * _P2, 31) * _P1
            h[at] = _rot(h[at] ^ k, 27) * _P1 + _P4
        pos += rest // 8 * 8
        rest %= 8
        at = np.flatnonzero(rest >= 4)
        if len(at):
            h[at] = _rot(h[at] ^ (w4[pos[at]].astype(np.uint64) * _P1), 23) * _P2 + _P3
            pos[at] += 4
            rest[at] -= 4
        for j in range(3):
            at = np.flatnonzero(rest > j)
            if not len(at):
                break
            h[at] = _rot(h[at] ^ (buf[pos[at] + j].astype(np.uint64) * _P5), 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h
