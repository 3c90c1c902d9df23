"""Media columns: payloads in archives of the shared store, read by byte range.

``write_archives`` packs each text as an 8-bit grey image (PNG, 192 samples a
row, lossless) into uncompressed ZIP archives and lists these in a manifest
table beside them. The ``MediaArchives`` data source plans shares of the
manifest's files; the driver sees neither archives nor ranges. A task takes the
byte ranges of its share, reads each archive's directory, takes the members
that begin in the range, opens each at its offset and streams record batches. A
member that fails is read again on its own, from its offset, on a new handle.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import discard, materialize, shared_dir, small_batches, text_blocks

#: Samples of an image row; payloads are padded to a multiple of it.
ROW = 192
#: Archives are closed beyond this size; a byte range has at most that many bytes.
ARCHIVE_BYTES, RANGE_BYTES = 64 << 20, 8 << 20
#: Archives of one manifest file, on average; bytes that a task reads.
MANIFEST_ARCHIVES, TASK_BYTES = 1024, 8 << 20
#: Reads of one member before its task fails (and Spark runs the task again).
ATTEMPTS = 3
#: Members of one record batch, and bytes.
BATCH_MEMBERS, BATCH_BYTES = 256, 8 << 20
PNG = b"\x89PNG\r\n\x1a\n"
SCHEMA = "archive string, member string, offset long, media binary, payload binary, n_bytes long"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes, n_bytes: int) -> bytes:
    """A grey PNG of the payload (a positive multiple of ROW bytes), with the unpadded length as text."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    filtered = np.zeros((len(rows), ROW + 1), dtype=np.uint8)
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"length\0" + str(n_bytes).encode()) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> tuple[bytes, int]:
    """Payload and unpadded length of a PNG that ``encode_image`` made; checks every chunk."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, parts, n_bytes, rows = 8, [], -1, 0
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            rows = struct.unpack(">I", data[4:8])[0]
        elif kind == b"tEXt":
            n_bytes = int(data.partition(b"\0")[2])
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    pixels = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(rows, ROW + 1)
    if pixels[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return pixels[:, 1:].tobytes(), n_bytes


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW, b" ")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def member_name(key: object) -> str:
    """A ZIP member's name for an id: ``null``, or ``id:`` and the id with odd characters escaped."""
    return "null" if key is None else "id:" + quote(str(key), safe="")


def write_archives(docs: DataFrame, directory: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Packs every row's text into archives under ``directory``; returns the manifest's folder.

    The manifest has a row ``path, size`` for each archive. An archive's name is
    new for every attempt of a task, and only what finished tasks report is
    listed, so archives of lost attempts are never read.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(directory)
        fs.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        archive = sink = name = None

        def close() -> None:
            if archive is not None:
                archive.close()
                size = sink.tell()
                sink.close()
                done.append((f"{directory}/{name}", size))

        for part, texts in text_blocks(batches, "_t"):
            for key, text in zip(part.column(0).to_pylist(), texts, strict=True):
                if archive is None or sink.tell() > ARCHIVE_BYTES:
                    close()
                    name = f"{uuid.uuid4().hex}.zip"
                    sink = fs.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(member_name(key)), encode_image(padded(text), len(text)))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], names=["path", "size"])

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_t"))
    listed = materialize(rows.mapInArrow(work, "path string, size long"), "media-listed")
    files = -(-max(listed.count(), 1) // MANIFEST_ARCHIVES)
    manifest = f"{directory}/manifest"
    listed.repartition(files, F.xxhash64("path")).sortWithinPartitions("path").write.mode("overwrite").parquet(manifest)
    discard(listed)
    return manifest


class Share(InputPartition):
    """Every ``shares``-th byte range of a manifest file's archives, from the ``number``-th."""

    def __init__(self, manifest: str, number: int, shares: int):
        self.manifest, self.number, self.shares = manifest, number, shares


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.manifest, self.bytes = options["manifest"], int(options["bytes"])
        self.step = int(options.get("rangebytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[Share]:
        """Shares of the manifest's files, by the archives' bytes in all; nothing is opened here."""
        scheme = self.manifest.split("//", 1)[0] + "//" if "//" in self.manifest else ""
        fs, root = _open(self.manifest)
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet"))
        shares = max(1, -(-self.bytes // (max(len(files), 1) * TASK_BYTES)))
        host = self.manifest[len(scheme) : len(self.manifest) - len(root)] if scheme and self.manifest.endswith(root) else ""
        return [Share(f"{scheme}{host}{path}", n, shares) for path in files for n in range(shares)]

    def _member(self, fs: pafs.FileSystem, path: str, offset: int, length: int) -> tuple[bytes, bytes, int]:
        """One member by its offset; read again on a new handle if it fails."""
        for attempt in range(1, self.attempts + 1):
            try:
                with fs.open_input_file(path) as f:
                    name, extra = struct.unpack("<26x2H", f.read_at(30, offset))
                    media = f.read_at(length, offset + 30 + name + extra)
                return (media, *decode_image(media))
            except (OSError, ValueError, struct.error, zlib.error):
                if attempt == self.attempts:
                    raise
        raise AssertionError

    def ranges(self, share: Share) -> Iterator[tuple[str, int, int]]:
        """Archive, start and stop of each byte range of the share."""
        fs, path = _open(share.manifest)
        number = 0
        with fs.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["path", "size"]):
                for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for start in range(0, size, self.step):
                        if number % share.shares == share.number:
                            yield uri, start, start + self.step
                        number += 1

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no manifest file at all
            return
        rows: list[tuple] = []
        size = 0
        for uri, start, stop in self.ranges(partition):
            fs, path = _open(uri)
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                members = [(i.filename, i.header_offset, i.file_size) for i in z.infolist() if start <= i.header_offset < stop]
            for name, offset, length in members:
                rows.append((uri, name, offset, *self._member(fs, path, offset, length)))
                size += 2 * len(rows[-1][4])
                if len(rows) >= BATCH_MEMBERS or size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    names = ["archive", "member", "offset", "media", "payload", "n_bytes"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class MediaArchives(DataSource):
    """Members of ZIP archives as rows: options ``manifest`` (folder of its files) and ``bytes`` (of all archives)."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, manifest: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All members of a manifest's archives."""
    spark.dataSource.register(MediaArchives)
    total = spark.read.schema("path string, size long").parquet(manifest).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return spark.read.format("media_archives").options(manifest=manifest, bytes=str(total), rangebytes=str(range_bytes)).load()


def feature(payload: bytes) -> str:
    """Mean and variance in thousandths, and the share in thousandths of each eighth of the sample range."""
    x = np.frombuffer(payload, dtype=np.uint8)
    count = np.bincount(x, minlength=256)
    n, values = len(x), np.arange(256)
    mean = int(count @ values) * 1000 // n
    square = int(count @ (values * values)) * 1000 // n
    parts = count.reshape(8, 32).sum(axis=1) * 1000 // n
    return f"{mean}:{square - mean * mean // 1000}:" + "-".join(map(str, parts.tolist()))


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str | None = None) -> DataFrame:
    """Stores every whole text as media, reads the stored bytes back and describes them.

    Returns ``id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature``, all but the id from what was read
    back. Null texts count as empty and are 192 spaces. Equal texts have equal
    values. A null id comes back null; repeated rows repeat; other columns are
    ignored; an empty table gives an empty result. The archives stay under
    ``directory`` (by default in the shared folder) as long as they are read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    where = directory or f"{shared_dir(spark)}/tidegrid/media-{uuid.uuid4().hex}"
    members = read_archives(spark, write_archives(docs, where, id_col, text_col))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            ids = [None if m == "null" else unquote(m[3:]) for m in col["member"]]
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(col["n_bytes"], pa.int64()), pa.array([len(p) for p in col["payload"]], pa.int64()), sha(col["payload"]), pa.array([zlib.crc32(p[-16:]) for p in col["payload"]], pa.int64()), pa.array([len(m) for m in col["media"]], pa.int64()), sha(col["media"]), pa.array([feature(p) for p in col["payload"]], pa.string())],
                names=["member", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    out = members.select("member", "media", "payload", "n_bytes").mapInArrow(work, "member string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumn("member", F.col("member").cast(kind)).withColumnRenamed("member", id_col)
