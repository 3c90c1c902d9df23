"""Near copies by the Jaccard similarity of their sets of word shingles.

Candidates are, first, the links of the SimHash index (``simhash``):
fingerprints of the same shingles within 3 bits. They hold most near copies, but
a pair at a similarity of 0.8 differs in about ten bits, which no guaranteed
number of shared positional bytes covers. So MinHash bands add what SimHash
can't reach: a pair with a similarity of 0.8 shares none of the 24 bands of 4
minima with a probability of 3 in a million, more similar ones with less. No
candidate is linked unless the similarity of its two sets, taken in full, is 0.8
or more.

At first the members of a bucket are held against three centres, of other
components than their own. Where that leaves a bucket of more than four in several
components, its members are dealt anew to finer buckets, of two and then of three
bands, with centres of their own. That joins large groups of copies in time in
proportion to their rows, but centres miss pairs. So what is still in several
components is then settled exactly: in each bucket of one band that is, all
pairs of different components are held against each other by sketches. A sketch
is the parities of the set's members by some low bits of their hashes; sets that
differ in d members have sketches that differ in at most d bits, so a pair whose
sketches differ in more than a similarity of 0.8 allows is none, and no other pair
is left out. A member's nearest ones are verified first, as they join most that
belongs together, then all pairs that are still in different components. Buckets
are dealt to cells of two blocks, so that no task holds a large one as a whole.
Every pair at 0.8 or more that shares a band ends in one component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, text_blocks
from .components import components
from .simhash import SENT_KEYS, fingerprints_from, links, shingle_hashes

#: Bands of a signature and minima of a band.
BANDS, ROWS = 24, 4
#: Least similarity of a link, as a fraction.
LEAST = (4, 5)
#: Members of a bucket that all others are compared with at first.
CENTRES = 3
#: Members of a block; a cell, which one task compares, holds two.
BLOCK = 1024
#: Bits of the largest sketch, and pairs (times words of a sketch) compared in one numpy step.
SKETCH_BITS, STEP = 1 << 16, 1 << 20
#: Bands that make up a key, by level of refinement.
LEVELS = [
    [(j,) for j in range(BANDS)],
    [(j, (j + d) % BANDS) for d in (1, 5) for j in range(BANDS)],
    [(j, (j + 1) % BANDS, (j + 2) % BANDS) for j in range(BANDS)],
]
_DRAWN = np.random.default_rng(5).integers(0, 1 << 63, (3, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The one member of the set of a text without words.
NONE = np.uint64(0)


def sets_of(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes."""
    return sets_from(*shingle_hashes(texts, shingle))


def sets_from(h: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    parts = np.split(h, np.cumsum(count)[:-1])
    return [np.unique(p) if len(p) else np.array([NONE]) for p in parts]


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of band keys for each set."""
    h = np.concatenate(sets)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j, (a, b, c) in enumerate(_DRAWN.T):
            low = np.minimum.reduceat((h ^ b) * a, start)
            keys[:, j // ROWS] = (keys[:, j // ROWS] ^ (low >> np.uint64(29)) ^ low) * c
        keys ^= keys >> np.uint64(31)
        return keys + np.arange(BANDS, dtype=np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches ``LEAST``."""
    num, den = LEAST
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return den * shared >= num * (len(both) - shared)


def sketch(s: np.ndarray) -> np.ndarray:
    """The parities of a set's members by the low bits of their hashes: two to four bits a member, 64 at least."""
    width = min(max(64, 1 << (2 * len(s) - 1).bit_length()), SKETCH_BITS)
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def candidates(part: np.ndarray, size: np.ndarray, side: np.ndarray, sketches: list[np.ndarray], within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of different parts that may be similar, and the share of members that differ at least.

    Unless ``within``, only pairs of different sides.
    """
    num, den = LEAST
    words = np.array([len(x) for x in sketches])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for w in np.unique(words):
        a = np.flatnonzero(words == w)
        own = np.stack([sketches[i] for i in a])
        # Similar sets have sketches of one length, or one is twice as long: its halves are laid upon each other.
        b = np.flatnonzero(words == 2 * w)
        both = np.concatenate([a, b])
        folded = np.concatenate([own, np.stack([sketches[i][:w] ^ sketches[i][w:] for i in b])]) if len(b) else own
        rows = max(1, STEP // len(both))
        for s in range(0, len(a), rows):
            i = a[s : s + rows, None]
            ok = (part[i] != part[both]) & (den * np.minimum(size[i], size[both]) >= num * np.maximum(size[i], size[both]))
            ok &= (words[both] > w) | (i < both)
            if not within:
                ok &= side[i] != side[both]
            x, y = np.nonzero(ok)
            for t in range(0, len(x), max(1, STEP // w)):
                u, v = x[t : t + max(1, STEP // w)] + s, y[t : t + max(1, STEP // w)]
                apart = np.bitwise_count(own[u] ^ folded[v]).sum(axis=1, dtype=np.int64)
                u, v = a[u], both[v]
                near = (num + den) * apart <= (den - num) * (size[u] + size[v])
                found.append((u[near], v[near], apart[near] / (size[u] + size[v])[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _unsettled(members: DataFrame, sets: DataFrame, nearest: bool) -> DataFrame:
    """Pairs ``(a, b)`` of a bucket's members ``(_key, _node, _p)`` in different components that may be similar.

    All such pairs, or with ``nearest`` only each member's nearest in a cell.
    """
    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in held], pa.int64()), pa.array([sketch(x).tobytes() for x in held], pa.binary())], names=["_node", "_n", "_sketch"])

    def close(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        at = [cell.column(c).to_numpy() for c in ("_key", "_i", "_j")]
        cut = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in at], axis=0)]))
        part, size, side, node = (cell.column(c).to_numpy() for c in ("_p", "_n", "_s", "_node"))
        sketches = [np.frombuffer(x, "<u8") for x in cell.column("_sketch").to_pylist()]
        found = []
        for s, e in zip(cut, [*cut[1:], len(part)], strict=True):
            i, j, apart = candidates(part[s:e], size[s:e], side[s:e], sketches[s:e], at[1][s] == at[2][s])
            if nearest:
                by = np.lexsort([np.tile(apart, 2), np.concatenate([i, j])])
                best = by[np.unique(np.concatenate([i, j])[by], return_index=True)[1]] % max(1, len(i))
                i, j = i[best], j[best]
            found.append(np.sort(np.stack([node[s:e][i], node[s:e][j]], axis=1), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # batches since the last cell began
        for batch in batches:
            if not batch.num_rows:
                continue
            at = [batch.column(i).to_numpy() for i in range(3)]
            open_at = int(np.all([x == x[-1] for x in at], axis=0).argmax())  # the last cell may go on
            if held and (open_at or any(held[-1].column(i)[-1].as_py() != at[i][-1] for i in range(3))):
                yield from close(pa.Table.from_batches([*held, batch.slice(0, open_at)]))
                held = []
            elif open_at:
                yield from close(pa.Table.from_batches([batch.slice(0, open_at)]))
            held.append(batch.slice(open_at))
        if held:
            yield from close(pa.Table.from_batches(held))

    marks = sets.join(members.select("_node").distinct(), "_node", "left_semi").mapInArrow(mark, "_node long, _n long, _sketch binary")
    # Large buckets are few: a BLOCK-th of the rows at most. Only their numbers of blocks travel, so no task reads one of them whole.
    blocks = members.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_g")).where("_g > 1")
    members = members.join(F.broadcast(blocks), "_key", "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(BLOCK), F.col("_node")), F.col("_g")).cast("int")
    dealt = members.select("_key", "_node", "_p", own.alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_g") - 1)).alias("_other"))
    cell = [F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") < F.col("_other")).cast("int").alias("_s")]
    cells = dealt.select("_key", *cell, "_p", "_node").join(marks, "_node").select("_key", "_i", "_j", "_s", "_p", "_n", "_node", "_sketch")
    return cells.repartition("_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j").mapInArrow(work, "a long, b long").distinct()


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that are similar."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            good = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    held = lambda n: sets.select(F.col("_node").alias(n), F.col("_set").alias(f"_{n}"))
    both = pairs.join(held("a"), "a").join(held("b"), "b").select("a", "b", "_a", "_b")
    return both.mapInArrow(work, "a long, b long")


def near_copies(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, component_id`` of every row that is linked with another.

    Words are ASCII-blank-parted after lower-casing A-Z; a text of fewer words
    than ``shingle`` is one shingle; texts without words (null too) are alike.
    The component is the smallest id reachable over pairs with a similarity of
    0.8 or more. Rows with a null id link others and are returned with a null
    id; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    node = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62)) + F.shiftrightunsigned(F.xxhash64(text), 3))
    rows = docs.select(node.alias("_node"), text.alias("_t"))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches, "_t"):
            h, count = shingle_hashes(texts, shingle)
            sets, fp = sets_from(h, count), fingerprints_from(h, count)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(bands_of(sets).view(np.int64).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp.view(np.int64)), keys], names=["_node", "_n", "_fp", "_keys"])

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches, "_t"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets_of(texts, shingle)], pa.binary())], names=["_node", "_set"])

    signed = materialize(rows.mapInArrow(sign, "_node long, _n long, _fp long, _keys array<long>"), "signatures")
    prints = materialize(signed.groupBy("_fp").agg(F.min("_node").alias("_rep")), "prints")
    alike_prints = signed.select("_node", "_fp").join(prints, "_fp").where("_node <> _rep").select(F.col("_rep").alias("a"), F.col("_node").alias("b"))
    by_print = materialize(links(prints).select("a", "b").unionByName(alike_prints), "print-links")
    alike = lambda m, n: LEAST[1] * F.least(m, n) >= LEAST[0] * F.greatest(m, n)
    # A set is fetched only for rows that some pair names; all rows that share a band may be.
    shared = signed.select("_node", F.explode("_keys").alias("_key"))
    several = shared.groupBy("_key").agg(F.min("_node").alias("lo"), F.max("_node").alias("hi")).where("lo < hi").select("_key")
    near = shared.join(several, "_key").select("_node").unionByName(by_print.select(F.col("a").alias("_node"))).unionByName(by_print.select(F.col("b").alias("_node"))).distinct()
    sets = materialize(rows.join(near, "_node", "left_semi").mapInArrow(fill, "_node long, _set binary"), "sets")
    asked = materialize(by_print.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    edges = materialize(_linked(asked, sets), "similar")
    label = components(edges)
    still = rest = signed
    for level, combos in enumerate(LEVELS):
        key = [F.xxhash64(F.lit(level), *[F.col("_keys")[j] for j in c]) for c in combos]
        known = label.withColumnRenamed("node", "_node")
        index = still.join(known, "_node", "left").select("_node", "_n", F.coalesce("component", "_node").alias("_p"), F.explode(F.array(*key)).alias("_key"))
        index = materialize(index, "bands")
        rest = rest if level else index
        one = lambda r: F.min(F.struct(F.xxhash64(F.lit(r), F.col("_node")).alias("o"), F.col("_node").alias("v"), F.col("_n").alias("n"), F.col("_p").alias("p")))
        buckets = index.groupBy("_key").agg(F.min("_p").alias("lo"), F.max("_p").alias("hi"), *[one(r).alias(f"c{r}") for r in range(CENTRES)]).where("lo < hi")
        members = index.join(buckets.select("_key", F.array(*[f"c{r}" for r in range(CENTRES)]).alias("_c")), "_key")
        pairs = members.select("_node", "_n", "_p", F.explode(F.filter("_c", lambda c: (c["p"] != F.col("_p")) & alike(F.col("_n"), c["n"]))).alias("_c"))
        pairs = pairs.select(F.least("_node", "_c.v").alias("a"), F.greatest("_node", "_c.v").alias("b")).distinct()
        fresh = materialize(pairs.join(asked, ["a", "b"], "left_anti"), "pairs")
        found = _linked(fresh, sets)
        old, edges = edges, materialize(edges.unionByName(found), "similar")
        discard(old)
        asked = asked.unionByName(fresh)
        label = components(edges)
        # Rows of buckets that are too large to have been compared outright and still are in parts.
        now = index.select("_key", "_node").join(label.withColumnRenamed("node", "_node"), "_node", "left").withColumn("_p", F.coalesce("component", "_node"))
        parts = now.groupBy("_key").agg(F.min("_p").alias("lo"), F.max("_p").alias("hi"), F.count(F.lit(1)).alias("m")).where(f"lo < hi AND m > {CENTRES + 1}").select("_key")
        again = materialize(index.join(parts, "_key").select("_node").distinct(), "open")
        if again.isEmpty():
            break
        still = signed.join(again, "_node", "left_semi")
    # The rest, exactly: buckets of one band that are still in parts. One of two members has been compared outright.
    for nearest in (True, False):
        now = rest.select("_key", "_node").join(label.withColumnRenamed("node", "_node"), "_node", "left").select("_key", "_node", F.coalesce("component", "_node").alias("_p"))
        parts = now.groupBy("_key").agg(F.min("_p").alias("lo"), F.max("_p").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi AND m > 2").select("_key")
        parts = materialize(parts, "parts")
        n = parts.count()
        if n == 0:
            break
        rest = materialize(now.join(F.broadcast(parts) if n <= SENT_KEYS else parts, "_key", "left_semi"), "rest")
        fresh = materialize(_unsettled(rest, sets, nearest).join(asked, ["a", "b"], "left_anti"), "pairs")
        found = _linked(fresh, sets)
        old, edges = edges, materialize(edges.unionByName(found), "similar")
        discard(old)
        asked = asked.unionByName(fresh)
        label = components(edges)
    discard(signed)
    ids = docs.select(F.col(id_col).cast("long").alias("_id"), node.alias("node")).distinct().join(label, "node")
    least = ids.groupBy("component").agg(F.min("_id").alias("component_id"))
    return ids.join(least, "component").select(F.col("_id").alias(id_col), "component_id")
