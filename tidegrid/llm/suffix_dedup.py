"""Removal of repeated byte strings by suffix sorting.

All strings of ``span`` bytes that repeat are found without a suffix array of
the whole corpus in one place:

1. Texts fall into pieces (``windows``): equal strings lie in pieces with the
   same k-gram. A task lists its pieces once each; of equal pieces only the
   earliest goes on, the later ones are repeats already. So a piece that a
   third of all texts hold crosses the network once a task.
2. By k-gram, equal pieces of different tasks are settled in the same way.
   Different pieces under one k-gram (partial overlaps) are contenders.
3. Contenders fetch their bytes. Each shard of contenders is suffix-sorted by
   external induced sorting (``suffix_sort``), and every run of suffixes with
   a common prefix of ``span`` bytes keeps its earliest place.
   A k-gram with very many contenders (a passage with ever new surroundings)
   is split first: each of its windows goes by its own content, the later of
   equal ones in a task are repeats at once, and shards get the rest.
4. The repeats of a document are united and cut from its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, text_blocks, xxh64
from .suffix_sort import Shard
from .windows import pieces, sections

SPAN = 100
#: Bytes of text whose pieces a task lists at once.
UNIT = 8 << 20
#: Bytes of text that are cut into pieces at once; each takes about 60 bytes of memory.
BLOCK = 1 << 19
#: Text bytes of a bucket of pieces, on average; a bucket is settled in one go.
BUCKET = 2 << 20
#: Text bytes of a shard in the final sort; a k-gram's contenders stay together.
SHARD = 1 << 20
#: Contenders of a k-gram from which on it is split by window: those that no longer fit in a shard.
HOT = SHARD // (2 * SPAN)
#: The id that stands for null: below all others.
NULL_ID = -(1 << 63)


def _earliest(gram: np.ndarray, content: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by k-gram, content, document and start; where a new content begins; which repeat an earlier one."""
    order = np.lexsort((first, doc, content, gram))
    g, c, d, f = gram[order], content[order], doc[order], first[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(head)[np.cumsum(head) - 1] if len(order) else order
    return order, head, (d != d[at]) | (f != f[at])  # equal places repeat nothing


def _spans(doc: np.ndarray, key: np.ndarray, first: np.ndarray, stop: np.ndarray):
    """Union of byte ranges by document, sorted."""
    order = np.lexsort((first, key, doc))
    d, k, f, s = doc[order], key[order], first[order], stop[order]
    if not len(d):
        return d, k, f, s
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    group = np.cumsum(new) - 1
    reach = np.maximum.accumulate(s + group * (1 << 40)) - group * (1 << 40)  # furthest end so far in the document
    fresh = new.copy()
    fresh[1:] |= f[1:] > reach[:-1]
    cut = np.flatnonzero(fresh)
    return d[cut], k[cut], f[cut], np.maximum.reduceat(s, cut)


def _rows(kind: int, bucket, doc, key, first, stop, gram=None, content=None) -> pa.RecordBatch:
    """Packed columns of one bucket: kind 0 candidates, 1 repeats."""
    parts = [np.asarray(doc, dtype="<i8"), np.asarray(key, dtype="<u4"), np.asarray(first, dtype="<u4"), np.asarray(stop, dtype="<u4")]
    if gram is not None:
        parts += [np.asarray(gram, dtype="<u8"), np.asarray(content, dtype="<u8")]
    return (kind, bucket, b"".join(p.tobytes() for p in parts))


def _read(blob: bytes, wide: bool):
    n = len(blob) // (36 if wide else 20)
    out, at = [], 0
    for dtype, size in (("<i8", 8), ("<u4", 4), ("<u4", 4), ("<u4", 4), ("<u8", 8), ("<u8", 8))[: 6 if wide else 4]:
        out.append(np.frombuffer(blob, dtype=dtype, count=n, offset=at))
        at += size * n
    return out


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "b", "v"])


def _text_key(text: bytes) -> int:
    """32 bits that tell apart texts under one id."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "little")


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Identity and compressed text of every row, for the two joins that texts pass."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for part, texts in text_blocks(batches, "_t"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_text_key(t) for t in texts], pa.int64()), pa.array([zip_.compress(t) for t in texts], pa.binary())], names=["_id", "_key", "_z"])

    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(work, "_id long, _key long, _z binary")


def _by_document(rows: DataFrame) -> DataFrame:
    """Byte ranges of each document as one packed value; task-wise unions keep it as small as the document's repeats."""
    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(b.schema.get_field_index("v")).to_pylist():
                doc, key, first, stop = _spans(*(x.astype(np.int64) for x in _read(blob, False)))
                cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else doc
                ends = np.array([*cut[1:], len(doc)][: len(cut)], dtype=np.int64)
                both = np.stack([first, stop], axis=1).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array(doc[cut]), pa.array(key[cut]), pa.array([both[s:e].tobytes() for s, e in zip(cut, ends, strict=True)], pa.binary())], names=["_id", "_key", "_r"])

    return rows.mapInArrow(spread, "_id long, _key long, _r binary").groupBy("_id", "_key").agg(F.collect_list("_r").alias("_r"))


def candidates(docs: DataFrame, id_col: str, text_col: str, span: int, buckets: int) -> DataFrame:
    """Pieces of all texts by bucket of their k-gram (kind 0), and repeats within a task's unit (kind 1)."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = serial = 0

        def flush():
            nonlocal serial
            doc, key, first, last, gram, content = (np.concatenate(x) for x in zip(*held, strict=True))
            order, head, again = _earliest(gram, content, doc, first)
            rows = []
            if again.any():
                o = order[again]
                d, k, f, s = _spans(doc[o], key[o], first[o], last[o] + span)
                serial += 1
                rows.append(_rows(1, (serial * 7919) % buckets, d, k, f, s))
            o = order[~again]  # equal places, of repeated rows, all go on
            bucket = (gram[o] >> np.uint64(44)).astype(np.int64) % buckets
            o, bucket = o[np.argsort(bucket, kind="stable")], np.sort(bucket)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(o) else o
            for s, e in zip(cut, [*cut[1:], len(o)][: len(cut)], strict=True):
                p = o[s:e]
                rows.append(_rows(0, int(bucket[s]), doc[p], key[p], first[p], last[p], gram[p], content[p]))
            return _batch(rows)

        for part, texts in text_blocks(batches, "_t", BLOCK):
            ids = part.column(0).to_numpy()
            keys = np.array([_text_key(t) for t in texts], dtype=np.int64)
            which, offset, parts = (list(x) for x in zip(*sections(texts, span, BLOCK), strict=True))
            which, offset = np.array(which), np.array(offset)
            step = max(1, len(parts)) if sum(map(len, parts)) <= 4 * BLOCK else 1  # a long text goes section by section
            for p in range(0, len(parts), step):
                section, first, last, gram, content, _, _ = pieces(parts[p : p + step], span)
                text = which[p + section]
                held.append([ids[text], keys[text], first + offset[p + section], last + offset[p + section], gram, content])
                size += sum(map(len, parts[p : p + step]))
                if size > UNIT:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(work, "kind int, b long, v binary")


def settle(found: DataFrame, span: int) -> DataFrame:
    """Repeats (kind 1) and contenders (kind 2: different pieces under one k-gram; 3: very many of them)."""
    hot_from = HOT

    def close(blobs: list[bytes]):
        doc, key, first, last, gram, content = (np.concatenate(x) for x in zip(*(_read(b, True) for b in blobs), strict=True))
        order, head, again = _earliest(gram, content, doc, first)
        rows = []
        o = order[again]
        if len(o):
            rows.append(_rows(1, 0, *_spans(*(x.astype(np.int64) for x in (doc[o], key[o], first[o])), last[o].astype(np.int64) + span)))
        g = gram[order]
        group = np.cumsum(np.concatenate([[True], g[1:] != g[:-1]])) - 1
        several = np.bincount(group, weights=head)[group] > 1
        many = np.bincount(group, weights=~again)[group] >= hot_from
        for kind, chosen in ((2, several & ~again & ~many), (3, several & ~again & many)):
            o = order[chosen]
            if len(o):
                rows.append(_rows(kind, 0, doc[o], key[o], first[o], last[o], gram[o], content[o]))
        return _batch(rows) if rows else None

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for kind, bucket, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == 1:
                    yield _batch([(1, 0, blob)])
                    continue
                if bucket != now and blobs:
                    if (out := close(blobs)) is not None:
                        yield out
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs and (out := close(blobs)) is not None:
            yield out

    return found.repartition(F.col("b")).sortWithinPartitions("b").mapInArrow(work, "kind int, b long, v binary")


def fetch(contenders: DataFrame, packed: DataFrame, span: int) -> DataFrame:
    """Contenders with their bytes, by shard key: places ``doc, key, f``, key ``g`` and content ``v``.

    The windows of a split k-gram come one by one under the hash of their
    content; those that a task has met earlier have no content, they are
    repeats.
    """
    unit = UNIT

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, blob in zip(b.column(b.schema.get_field_index("kind")).to_pylist(), b.column(b.schema.get_field_index("v")).to_pylist(), strict=True):
                doc, key, first, last, gram, _ = _read(blob, True)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key.astype(np.int64)), pa.array(first.astype(np.int64)), pa.array(last.astype(np.int64)), pa.array(gram.view(np.int64)), pa.array(np.full(len(doc), kind == 3))], names=["_id", "_key", "f", "l", "g", "many"])

    wanted = contenders.mapInArrow(spread, "_id long, _key long, f long, l long, g long, many boolean")
    wanted = wanted.groupBy("_id", "_key").agg(F.collect_list(F.struct("f", "l", "g", "many")).alias("w"))  # a document's own pieces

    def windows_of(seen: dict[bytes, tuple[int, int, int]]) -> list[tuple]:
        contents = list(seen)
        buf = np.frombuffer(b"".join(contents) + b"\0" * 32, dtype=np.uint8)
        at = np.arange(len(contents)) * span
        g = xxh64(buf, at, at + span, 5).view(np.int64).tolist()
        return [(*place, k, c) for (c, place), k in zip(seen.items(), g, strict=True)]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc", "key", "f", "g", "v"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        seen: dict[bytes, tuple[int, int, int]] = {}  # windows of split k-grams and their earliest places
        for b in batches:
            out: list[tuple] = []
            for doc, key, z, w in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                text = unzip.decompress(z)
                for x in w:
                    if not x["many"]:
                        out.append((doc, key, x["f"], x["g"], text[x["f"] : x["l"] + span]))
                        continue
                    for at in range(x["f"], x["l"] + 1):
                        content, place = text[at : at + span], (doc, key, at)
                        old = seen.setdefault(content, place)
                        if (old[0], old[2]) > (doc, at):
                            seen[content], place, old = place, old, place
                        if (old[0], old[2]) != (place[0], place[2]):
                            out.append((*place, place[2], None))
                        elif old != place:  # the same place in another row with this id
                            out += windows_of({content: place})
            if len(seen) * span > unit:
                out += windows_of(seen)
                seen = {}
            if out:
                yield batch(out)
        if seen:
            yield batch(windows_of(seen))

    return packed.join(wanted, ["_id", "_key"]).select("_id", "_key", "_z", "w").mapInArrow(cut, "doc long, key long, f long, g long, v binary")


def _repeats(doc: np.ndarray, key: np.ndarray, first: np.ndarray, contents: list[bytes], span: int, memory: int | None = None):
    """Byte ranges covered by strings that occur earlier among the contents."""
    size = np.array([len(c) for c in contents], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    raw = np.frombuffer(b"\0".join(contents) + b"\0", dtype=np.uint8)
    text = raw.astype(np.uint16) + 1
    text[begin[1:] - 1] = 0
    shard = Shard(text, span, memory) if memory else Shard(text, span)
    held: list[np.ndarray] = []  # places of a run that may go on
    flagged: list[np.ndarray] = []

    def close(pos: np.ndarray, run: np.ndarray) -> None:
        seg = np.searchsorted(begin, pos, side="right") - 1
        inside = pos + span < begin[seg + 1]
        pos, run, seg = pos[inside], run[inside], seg[inside]
        if not len(pos):
            return
        d, f = doc[seg], first[seg] + pos - begin[seg]
        o = np.lexsort((f, d, run))
        d, f, r = d[o], f[o], run[o]
        head = np.concatenate([[True], r[1:] != r[:-1]])
        at = np.flatnonzero(head)[np.cumsum(head) - 1]
        flagged.append(pos[o][(d != d[at]) | (f != f[at])])

    for pos, lcp in shard.suffixes():
        starts = np.flatnonzero(lcp < span)
        if not len(starts):
            held.append(pos)
            continue
        last = starts[-1]
        whole = np.concatenate([*held, pos[:last]])
        run = np.cumsum(np.concatenate([np.zeros(len(whole) - last, np.int64), (lcp[:last] < span).astype(np.int64)]))
        several = np.bincount(run)[run] > 1 if len(run) else run.astype(bool)
        close(whole[several], run[several])
        held = [pos[last:]]
    whole = np.concatenate(held) if held else np.zeros(0, np.int64)
    if len(whole) > 1:
        close(whole, np.zeros(len(whole), np.int64))
    pos = np.concatenate(flagged) if flagged else np.zeros(0, np.int64)
    seg = np.searchsorted(begin, pos, side="right") - 1
    f = first[seg] + pos - begin[seg]
    return _spans(doc[seg], key[seg], f, f + span)


def compare(contents: DataFrame, span: int) -> DataFrame:
    """Repeats (kind 1) among contenders, shard by shard."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, now = 0, None

        def flush():
            doc, key, first, _, v = (list(x) for x in zip(*held, strict=True))
            return _batch([_rows(1, 0, *_repeats(np.array(doc), np.array(key), np.array(first), v, span))])

        for batch in batches:
            known: list[tuple] = []  # repeats already
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if row[4] is None:
                    known.append(row[:3])
                    continue
                if size > SHARD and row[3] != now:
                    yield flush()
                    held, size = [], 0
                now = row[3]
                held.append(row)
                size += len(row[4])
            if known:
                doc, key, first = (np.array(x) for x in zip(*known, strict=True))
                yield _batch([_rows(1, 0, *_spans(doc, key, first, first + span))])
        if held:
            yield flush()

    return contents.repartition(F.col("g")).sortWithinPartitions("g").mapInArrow(work, "kind int, b long, v binary")


def remove_repeats(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Cuts every byte that a ``span``-byte string covers which also starts earlier.

    Returns ``id_col, n_bytes, n_removed, n_spans, kept_sha256`` (and
    ``kept_bytes`` with ``keep_text``) for every row. Earlier is a smaller id
    or, in the same document, an earlier start; matches never cross documents
    and are judged on the input. Null and short texts lose nothing unless they
    are ``span`` bytes long. Null ids come first and count as one document's;
    rows with the same id and text are the same document and don't remove each
    other's bytes. Other columns are ignored; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col)).cast("long")), F.lit(0))).first()[0]
    buckets = max(128, total // BUCKET)
    packed = _packed(docs, id_col, text_col)
    settled = materialize(settle(candidates(docs, id_col, text_col, span, buckets), span), "suffix-settled")
    contents = fetch(settled.where("kind IN (2, 3)"), packed, span)
    found = settled.where("kind = 1").unionByName(compare(contents, span))
    ranges = _by_document(found)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            ids, _, zs, rs = (b.column(i).to_pylist() for i in range(4))
            out: list[tuple] = []
            for z, r in zip(zs, rs, strict=True):
                text = unzip.decompress(z)
                r = np.concatenate([np.frombuffer(x, dtype="<u4").reshape(-1, 2) for x in r]).astype(np.int64) if r else np.zeros((0, 2), np.int64)
                one = np.zeros(len(r), np.int64)
                _, _, first, stop = _spans(one, one, r[:, 0], r[:, 1])
                edges = [0, *np.stack([first, stop], axis=1).ravel().tolist(), len(text)]
                kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                out.append((len(text), int((stop - first).sum()), len(first), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            cols = zip(*out, strict=True) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    out = packed.join(ranges, ["_id", "_key"], "left").select("_id", "_key", "_z", "_r").mapInArrow(cut, "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    own = F.when(F.col("_id") != NULL_ID, F.col("_id")).cast(kind).alias(id_col)
    return out.select(own, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_bytes"] if keep_text else []))
