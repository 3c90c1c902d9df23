"""SimHash near-duplicates with a byte-position inverted index.

Fingerprints of 64 bits are 8 positional bytes. Two that differ in at most 3
bits share at least 5 of the 8, which is the guaranteed minimum of the count
filter. Posting lists of single bytes would pair almost everything, so a
posting is a block of four positions with their bytes: the 14 blocks of the
Steiner system S(3, 4, 8), closed under complement, have a block inside any 5
positions, so every pair with 5 shared positional bytes meets in some posting.
Within a posting the shared positional bytes of every pair are tallied, pairs
below 5 are dropped, and only the rest is verified by its differing bits; a
spanning forest of the verified links leaves the posting.

A posting of more than ``DIRECT`` fingerprints is split before it is shuffled,
by further parts of the fingerprint as keys: a fifth byte, which a pair must
share anyway, then three of the six half bytes left, of which 3 differing bits
leave at least three alone. Then 52 of 64 bits are the key, so no posting can
hold more than 4,096 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, runs, small_batches, text_blocks, xxh64
from .components import components

#: Four positions of eight whose exclusive or is zero: S(3, 4, 8).
BLOCKS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
#: Shared positional bytes of two fingerprints with at most 3 differing bits.
SHARED = 5
#: Fingerprints of a posting that are compared all with all; longer postings are split. At least 4096 (the bits that the last split leaves).
DIRECT = 4096
#: Split postings up to which their keys are broadcast (16 MB); beyond, they are joined.
SENT_KEYS = 1 << 20


def shingle_hashes(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' word shingles, repeats included, and each text's number of them."""
    buf, starts, ends, first = runs(texts, SPACE)
    # Words joined by one space each, so that a shingle is a slice.
    word_len = ends - starts
    at = np.concatenate([[0], np.cumsum(word_len + 1)])
    joined = np.full(at[-1] + 32, 0x20, dtype=np.uint8)
    if len(starts):
        inside = np.arange(at[-1]) - np.repeat(at[:-1], word_len + 1)
        source = np.repeat(starts, word_len + 1) + inside
        keep = inside < np.repeat(word_len, word_len + 1)
        joined[: at[-1]][keep] = buf[source[keep]]
    words = first[1:] - first[:-1]
    count = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
    head = np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    last = head + np.minimum(np.repeat(words, count), shingle) - 1
    h = xxh64(joined, at[head], at[last] + word_len[last]) if len(head) else np.zeros(0, np.uint64)
    return h, count


def fingerprints_of(texts: list[bytes], shingle: int) -> np.ndarray:
    """SimHash of each text over its word shingles, repeats included; no words: 0."""
    return fingerprints_from(*shingle_hashes(texts, shingle))


def fingerprints_from(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """SimHash of each text from its shingles' hashes and their number."""
    out = np.zeros(len(count), dtype=np.uint64)
    some = np.flatnonzero(count)
    step = 1 << 16
    ones = np.zeros((len(count), 64), dtype=np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    for s in range(0, len(h), step):
        bits = np.unpackbits(h[s : s + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        d = doc[s : s + step]
        cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        ones[d[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    on = (2 * ones > count[:, None]).astype(np.uint8)
    out[some] = np.packbits(on[some], axis=1, bitorder="little").reshape(-1).view("<u8")
    return out


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, _fp)`` of every row."""
    small_batches(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches, "_t"):
            fp = fingerprints_of(texts, shingle)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["_id", "_fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(work, "_id long, _fp long")


def tallied(x: np.ndarray) -> np.ndarray:
    """Shared positional bytes of pairs, from their exclusive ors: bytes that are zero."""
    x = x | (x >> np.uint64(4))
    x = x | (x >> np.uint64(2))
    x = x | (x >> np.uint64(1))
    return 8 - np.bitwise_count(x & np.uint64(0x0101010101010101))


def _forest(fp: np.ndarray, bits: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (index pairs) of a spanning forest of the links among ``fp``."""
    n = len(fp)
    left, right = [], []
    step = max(1, (1 << 20) // n)
    for s in range(0, n, step):
        x = fp[s : s + step, None] ^ fp[None, :]
        i, j = np.nonzero(tallied(x) >= shared)  # the count filter
        ok = i + s < j
        i, j = i[ok], j[ok]
        near = np.bitwise_count(x[i, j]) <= bits  # verified last
        left.append(i[near] + s)
        right.append(j[near])
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    other = np.flatnonzero(root != np.arange(n))
    return root[other], other


def _byte(p: int) -> Column:
    return F.shiftrightunsigned("_fp", 8 * p).bitwiseAND(F.lit(255))


def _half(p: int) -> Column:
    return F.shiftrightunsigned("_fp", 4 * p).bitwiseAND(F.lit(15))


def _joined(first: Column, *parts: tuple[Column, int]) -> Column:
    for part, width in parts:
        first = F.shiftleft(first, width).bitwiseOR(part)
    return first


def _by_four(prints: DataFrame) -> DataFrame:
    """Postings of four positional bytes: ``_b`` is the block, ``_v`` the bytes."""
    one = [F.struct(F.lit(n).alias("_b"), _joined(F.lit(0).cast("long"), *[(_byte(p), 8) for p in block]).alias("_v")) for n, block in enumerate(BLOCKS)]
    return prints.select(F.explode(F.array(*one)).alias("_k"), "_fp", "_rep").select("_k._b", "_k._v", "_fp", "_rep")


def _by_five(rows: DataFrame) -> DataFrame:
    """Postings of four and one more byte: ``_b`` is 8 x block + position + 16."""
    parts = lambda n, block: [F.struct(F.lit(16 + 8 * n + p).alias("_b"), _joined(F.col("_v"), (_byte(p), 8)).alias("_v")) for p in range(8) if p not in block]
    more = F.array()
    for n, block in reversed(list(enumerate(BLOCKS))):
        more = F.when(F.col("_b") == n, F.array(*parts(n, block))).otherwise(more) if n < len(BLOCKS) - 1 else F.array(*parts(n, block))
    return rows.select(F.explode(more).alias("_k"), "_fp", "_rep").select("_k._b", "_k._v", "_fp", "_rep")


def _by_halves(rows: DataFrame) -> DataFrame:
    """Postings of five bytes and three of the six half bytes left: ``_b`` is 20 x the former and the choice, + 1000."""
    def halves(n: int, p: int) -> list[int]:
        return [h for q in range(8) if q != p and q not in BLOCKS[n] for h in (2 * q, 2 * q + 1)]

    more = None
    for n, block in enumerate(BLOCKS):
        for p in range(8):
            if p in block:
                continue
            b = 16 + 8 * n + p
            own = F.array(*[F.struct(F.lit(1000 + 20 * b + i).alias("_b"), _joined(F.col("_v"), *[(_half(h), 4) for h in three]).alias("_v")) for i, three in enumerate(combinations(halves(n, p), 3))])
            more = F.when(F.col("_b") == b, own) if more is None else more.when(F.col("_b") == b, own)
    return rows.select(F.explode(more).alias("_k"), "_fp", "_rep").select("_k._b", "_k._v", "_fp", "_rep")


def postings(prints: DataFrame) -> DataFrame:
    """``(_b, _v, _fp, _rep)``: the index, with long postings replaced by their parts.

    Sizes are counted with sums formed before the shuffle, so a long posting
    reaches no task as a whole.
    """
    done, rows = None, _by_four(prints)
    for split in (_by_five, _by_halves):
        long = materialize(rows.groupBy("_b", "_v").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > DIRECT).select("_b", "_v"), "long-postings")
        n = long.count()
        if n == 0:
            break
        small = F.broadcast(long) if n <= SENT_KEYS else long
        kept = rows.join(small, ["_b", "_v"], "left_anti")
        done = kept if done is None else done.unionByName(kept)
        rows = split(rows.join(small, ["_b", "_v"], "left_semi"))
    return rows if done is None else done.unionByName(rows)


def links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """``(a, b)`` edges whose components are those of all fingerprint pairs within ``bits`` (at most 3).

    ``prints`` has one row a distinct fingerprint: ``_fp`` and the node ``_rep``.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees links of at most 3 differing bits")
    index = postings(prints).repartition(F.col("_b"), F.col("_v")).sortWithinPartitions("_b", "_v")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(b, v, fp, rep):
            cut = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (v[1:] != v[:-1])])) if len(b) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([cut, [len(b)]]))
            found = []
            for s, m in zip(cut[size > 1], size[size > 1], strict=True):
                i, j = _forest(fp[s : s + m], bits, SHARED)
                if len(i):
                    found.append(np.stack([rep[s + i], rep[s + j]], axis=1))
            if found:
                pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held: list[list[np.ndarray]] = []  # batches since the last posting began
        for batch in batches:
            cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()]
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])  # this posting may go on
            open_at = int(last.argmax())
            if open_at or (held and (held[-1][0][-1], held[-1][1][-1]) != (cols[0][-1], cols[1][-1])):
                held.append([c[:open_at] for c in cols])
                yield from close(*[np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
            held.append([c[open_at:] for c in cols])
        if held:
            yield from close(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return index.mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and near-duplicate component of every row.

    Returns ``id_col, fingerprint, component_id``. Words are ASCII-blank-parted
    after lower-casing A-Z; a text of fewer words than ``shingle`` is one
    shingle, one of none (null too) has fingerprint zero and is linked like any
    other. Fingerprints with at most ``bits`` differing bits are linked; the
    component is the smallest id reachable. Null ids keep their fingerprint and
    get the component of their equals (null if those have no id either).
    Repeated rows are returned as often; other columns are ignored; an empty
    table gives an empty result.
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = materialize(prints.groupBy("_fp").agg(F.min("_id").alias("_rep")), "prints")
    # A fingerprint met only under null ids still links others: it gets a node below all ids.
    node = F.coalesce("_rep", F.lit(-(1 << 62)) + F.shiftrightunsigned("_fp", 3))
    linked = components(links(distinct.select("_fp", node.alias("_rep")), bits))
    named = distinct.withColumn("_node", node).join(linked.withColumnRenamed("node", "_node"), "_node", "left").select("_fp", "_rep", F.coalesce("component", "_node").alias("_c"))
    smallest = named.groupBy("_c").agg(F.min("_rep").alias("component_id"))
    by_fp = named.join(smallest, "_c").select("_fp", "component_id")
    out = prints.join(by_fp, "_fp")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
