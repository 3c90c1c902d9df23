"""Language-model scores from a log-frequency Bloom filter.

Unigrams and bigrams of the training texts are counted over the whole corpus,
those met once too. A count is quantised to its level among ``THRESHOLDS``
(exact up to 8, then four levels an octave), and the n-gram goes into a Bloom
filter once for each level up to its own, as (n-gram, 1), (n-gram, 2), ...
The filter is broadcast; a worker asks for (n-gram, 1), (n-gram, 2), ... until
one is missing. The level reached bounds the count from both sides, unless
probes err, which can only raise it.

The model is a bigram estimate with a Dirichlet prior on unigram estimates,

    p1(w)     = (low(w) + 1) / (N + V + 1)
    p(w | h)  = (low(h w) + mu p1(w)) / (high(h) + mu + e V)

with the least count of an n-gram's level for the numerators and the greatest
one of the history's level for the denominator. The counts after a history sum
up to its own, so the probabilities after any history sum up to one at most,
less what quantising loses. Of the V words, a share e is found after a history
though it never followed it, as membership probes err; e is the filter's share
of set bits to the power of the probes, and e V (with three standard deviations) in the
denominator makes room for them. The first level has more probes than the others, so that e V stays
below the prior's weight. The plain add-one baseline beside them uses exact
counts.

A small corpus has its filter broadcast. That of a larger one grows with it and
is never in one place: n-grams are dealt to buckets by hash, and the task that
counts a bucket's n-grams also builds the bucket's part of the filter and probes
it for the blocks of text that sent them. What travels is packed, sorted,
difference-coded hashes out and one byte an n-gram back; a bucket is the unit of
work and the largest thing in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, runs, small_batches, text_blocks, xxh64

#: Segments of the filter: a member's bits all lie in one, and a bucket of counts fills one.
SEGMENT_BITS = 12
#: Bits of an n-gram's hash; the upper ones are its segment.
HASH_BITS = 48
#: Probes of the first level, which decides whether an n-gram is held at all, and of the others.
PROBES, MORE_PROBES = 12, 4
#: Least counts of the levels 1, 2, ...: 1 to 7, then 4 to 7 times powers of two.
THRESHOLDS = np.array([1, 2, 3, *[m << k for k in range(59) for m in (4, 5, 6, 7)]], dtype=np.int64)
#: Least and greatest count of levels 0, 1, 2, ...
LOW, HIGH = np.concatenate([[0], THRESHOLDS[:-1]]).astype(np.float64), np.concatenate([[0], THRESHOLDS[1:] - 1]).astype(np.float64)
#: Share of bits set, at every size of corpus, and least size.
FILL, MIN_BITS = 0.4, 1 << 20
#: Training tokens up to which the filter is broadcast: two n-grams a token with 16 marks at most make 33 MB.
SENT_TOKENS = 1 << 22
#: Bytes of text of a block that sends its n-grams to the buckets, and tokens of a bucket on average.
TEXT_BLOCK, BUCKET_TOKENS = 4 << 20, 1 << 20
#: Tokens that a counting task gathers before it passes their counts on.
FLUSH = 2_000_000
#: Most frequent words whose exact counts are broadcast (16 MB); rarer words are joined.
HEAD = 1 << 20
#: Weight of the prior, in counts.
MU = 64.0
#: Hashes of the marks at a text's end and before its start.
END, START = np.uint64(0x656E64), np.uint64(0x7374617274)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def held_out(id_col: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end mark, and where texts begin in them."""
    buf, starts, ends, first = runs(texts, SPACE)
    h = xxh64(buf, starts, ends, 1)
    n = np.diff(first)
    begin = first + np.arange(len(first))
    out = np.full(begin[-1], END, dtype=np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, begin


def grams(token: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of each token and of each with the token before it."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[begin[:-1]] = START
    with np.errstate(over="ignore"):
        pair = _mix(before * _M1 + _mix(token ^ _M2))
    return _mix(token) >> np.uint64(64 - HASH_BITS), pair >> np.uint64(64 - HASH_BITS)


def room(words: int) -> float:
    """Weight of the prior and of the n-grams that err: their expected number after a history, and three deviations."""
    erring = FILL**PROBES * words
    return MU + erring + 3 * erring**0.5


def bits_for(marks: int, fill: float) -> int:
    """Bits, in whole bytes, of which ``marks`` probes set the share ``fill``."""
    return int(marks / -np.log1p(-fill)) // 8 * 8 + 8


def marks_of(counts: np.ndarray) -> int:
    return PROBES * len(counts) + MORE_PROBES * int((level_of(counts) - 1).sum())


def level_of(counts: np.ndarray) -> np.ndarray:
    """Levels of counts; 0 for none."""
    return np.searchsorted(THRESHOLDS, counts, side="right")


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    gaps = np.diff(keys, prepend=np.uint64(0))
    wide = bool(len(gaps)) and int(gaps.max()) >= 1 << 32
    return bytes([wide]) + gaps.astype("<u8" if wide else "<u4").tobytes() + counts.astype("<u4").tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = 8 if blob[0] else 4
    n = (len(blob) - 1) // (size + 4)
    gaps = np.frombuffer(blob, dtype=f"<u{size}", count=n, offset=1).astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64), np.frombuffer(blob, dtype="<u4", count=n, offset=1 + n * size).astype(np.int64)


def _sums(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[cut], np.add.reduceat(counts[order], cut) if len(keys) else counts


def word_counts(train: DataFrame) -> DataFrame:
    """``(h, n)``: exact counts of training tokens by 64-bit hash, end marks too."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def flush():
            k, c = _sums(np.concatenate(keys), np.concatenate(counts))
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["h", "n"])

        for _, texts in text_blocks(batches, "_t"):
            k, c = _sums(tokens(texts)[0])
            keys.append(k)
            counts.append(c)
            size += len(k)
            if size > FLUSH:
                yield flush()
                keys, counts, size = [], [], 0
        if keys:
            yield flush()

    return train.mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def probes(level: int) -> int:
    return PROBES if level == 1 else MORE_PROBES


class Filter:
    """The log-frequency Bloom filter: segments of ``segment_bits`` bits, whole bytes."""

    def __init__(self, data: np.ndarray, segment_bits: int):
        self.data, self.segment_bits = data, segment_bits
        self.segments = 8 * len(data) // segment_bits  # all of them, or one by itself

    @staticmethod
    def hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            h = _mix(keys * _M1 + np.uint64(level))
        return h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)

    @staticmethod
    def place(one: np.ndarray, two: np.ndarray, probe: int, segment_bits: int) -> np.ndarray:
        """Bit numbers within the members' segments."""
        return ((one + np.uint64(probe) * two) & np.uint64(0xFFFFFFFF)) * np.uint64(segment_bits) >> np.uint64(32)

    @staticmethod
    def segment(keys: np.ndarray, counts: np.ndarray, segment_bits: int) -> np.ndarray:
        """One segment's bytes with the members ``keys`` at their quantised counts."""
        bits = np.zeros(segment_bits, dtype=np.uint8)
        level = level_of(counts)
        for j in range(1, int(level.max(initial=0)) + 1):
            one, two = Filter.hashes(keys[level >= j], j)
            for p in range(probes(j)):
                bits[Filter.place(one, two, p, segment_bits)] = 1
        return np.packbits(bits, bitorder="little")

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels by repeated probes: 0 if not held; never below the true one."""
        base = (keys >> np.uint64(HASH_BITS - SEGMENT_BITS)) * np.uint64(self.segment_bits) if self.segments > 1 else np.zeros(len(keys), np.uint64)
        out = np.zeros(len(keys), dtype=np.int64)
        live = np.arange(len(keys))
        for j in range(1, len(THRESHOLDS)):
            one, two = self.hashes(keys[live], j)
            for p in range(probes(j)):
                bit = base[live] + self.place(one, two, p, self.segment_bits)
                hit = (self.data[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                live, one, two = live[hit], one[hit], two[hit]
            if not len(live):
                break
            out[live] = j
        return out


def build_filter(train: DataFrame) -> tuple[DataFrame, int]:
    """Counts all n-grams of the training rows and fills the filter: segments ``(s, v)`` and their bits."""
    bucket_bits = SEGMENT_BITS
    shift = np.uint64(HASH_BITS - bucket_bits)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            k, c = _sums(np.concatenate(held))
            bucket = (k >> shift).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            low = k & ((np.uint64(1) << shift) - np.uint64(1))
            ends = np.concatenate([cut[1:], [len(k)]])
            blobs = [_pack(low[s:e], c[s:e]) for s, e in zip(cut, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(blobs, pa.binary())], names=["b", "v"])

        for _, texts in text_blocks(batches, "_t"):
            held += grams(*tokens(texts))
            size += len(held[-1])
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(bucket: int, blobs: list[bytes]):
            parts = [_unpack(x) for x in blobs]
            k, c = _sums(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            return pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([marks_of(c)]), pa.array([_pack(k, c)], pa.binary())], names=["b", "m", "v"])

        now, blobs = None, []
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != now and blobs:
                    yield close(now, blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield close(now, blobs)

    packed = train.mapInArrow(count, "b long, v binary").repartition(F.col("b")).sortWithinPartitions("b")
    merged = materialize(packed.mapInArrow(merge, "b long, m long, v binary"), "lm-counts")
    marks = merged.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    segment_bits = bits_for(max(marks >> SEGMENT_BITS, 1), min(FILL, max(marks, 1) / MIN_BITS))

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, c = _unpack(blob)
                data = Filter.segment(k | (np.uint64(bucket) << shift), c, segment_bits)
                yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([data.tobytes()], pa.binary())], names=["s", "v"])

    return merged.select("b", "v").mapInArrow(fill, "s long, v binary"), segment_bits


def gathered(segments: DataFrame, segment_bits: int) -> Filter:
    """The whole filter on the driver; for small corpora (``SENT_TOKENS``)."""
    width = segment_bits >> 3
    data = np.zeros(width << SEGMENT_BITS, dtype=np.uint8)
    for r in segments.toLocalIterator():
        data[r.s * width : (r.s + 1) * width] = np.frombuffer(r.v, dtype=np.uint8)
    return Filter(data, segment_bits)


#: Key of the end mark.
END_KEY = grams(np.array([END]), np.array([0, 1]))[0]


def _by_buckets(rows: DataFrame, tokens_in_all: int, rated: Callable, result: str) -> DataFrame:
    """What ``rated`` yields with a filter that no worker holds as a whole.

    Texts are kept in blocks. A block sends its distinct n-grams, with how
    often its training texts have them, to their buckets; a bucket counts,
    builds its part of the filter, probes it for every block and sends levels
    back.
    """
    bucket_bits = max(8, (tokens_in_all // BUCKET_TOKENS).bit_length())
    shift, fill_share, block_bytes = np.uint64(HASH_BITS - bucket_bits), FILL, TEXT_BLOCK

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def close():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

        for part, texts in text_blocks(batches, "_t", block_bytes):
            more = sum(map(len, texts))
            if held and size + more > block_bytes:
                yield close()
                held, size = [], 0
            held.append(part)
            size += more
        if held:
            yield close()

    def opened(blob: bytes) -> tuple[pa.RecordBatch, list[bytes]]:
        part = pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]
        return part, [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part, texts = opened(blob)
                token, begin = tokens(texts)
                one, two = grams(token, begin)
                trains = np.repeat(~part.column(2).to_numpy(zero_copy_only=False), np.diff(begin)).astype(np.int64)
                keys, n = _sums(np.concatenate([one, two, END_KEY]), np.concatenate([trains, trains, [0]]))
                bucket = (keys >> shift).astype(np.int64)
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                low = keys & ((np.uint64(1) << shift) - np.uint64(1))
                found = [_pack(low[s:e], n[s:e]) for s, e in zip(cut, [*cut[1:], len(keys)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(np.full(len(cut), block)), pa.array(found, pa.binary())], names=["bucket", "block", "v"])

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(bucket: int, asked: list[tuple[int, bytes]]) -> pa.RecordBatch:
            parts = [_unpack(v) for _, v in asked]
            every, n = _sums(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
            held = n > 0
            bits = bits_for(max(marks_of(n[held]), 1), fill_share)
            lm = Filter(Filter.segment(every[held], n[held], bits), bits)
            level = lm.levels(every).astype(np.uint8)  # every distinct n-gram is probed once
            back = [level[np.searchsorted(every, k)].tobytes() for k, _ in parts]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in asked]), pa.array(np.full(len(asked), bucket)), pa.array(back, pa.binary())], names=["block", "part", "v"])

        now, asked = None, []
        for batch in batches:
            for bucket, block, v in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if bucket != now and asked:
                    yield close(now, asked)
                    asked = []
                now = bucket
                asked.append((block, v))
        if asked:
            yield close(now, asked)

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            now, blob, got = None, None, []

            def close():
                part, texts = opened(blob)
                keys = np.unique(np.concatenate([*grams(*tokens(texts)), END_KEY]))
                found = np.concatenate(got).astype(np.int64)  # buckets in order, as keys are
                return part, texts, lambda k: found[np.searchsorted(keys, k)]

            for batch in batches:
                for block, part, v in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                    if block != now and now is not None:
                        yield close()
                    if part < 0:
                        now, blob, got = block, v, []
                    else:
                        got.append(np.frombuffer(v, dtype=np.uint8))
            if now is not None:
                yield close()

        yield from rated(blocks())

    blocks = materialize(rows.mapInArrow(pack, "rows binary").select(F.monotonically_increasing_id().alias("block"), "rows"), "lm-blocks")
    asked = blocks.mapInArrow(ask, "bucket long, block long, v binary").repartition(F.col("bucket")).sortWithinPartitions("bucket")
    levels = asked.mapInArrow(answer, "block long, part long, v binary")
    both = blocks.select("block", F.lit(-1).cast("long").alias("part"), F.col("rows").alias("v")).unionByName(levels)
    return both.repartition(F.col("block")).sortWithinPartitions("block", "part").mapInArrow(rate, result)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Baseline and model log10 probabilities of every row's whole text.

    Returns ``id_col, held_out, n_tokens, n_known, train_tokens, base_score,
    score``. Rows whose crc32 of the id as text (null: empty) mod 7 is 2 are
    held out, the others train. Words are ASCII-blank-parted after lower-casing
    A-Z, then comes one end mark; a null or empty text is the end mark alone.
    ``score`` is the sum over all tokens of log10 p(token | token before).
    Words are counted by 64-bit hash. Repeated rows count as often and are
    scored alike; without training rows all counts are 0; an empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), held_out(F.col(id_col)).alias("_out"))
    train = rows.where("NOT _out").select("_t")
    vocabulary = materialize(word_counts(train), "lm-words")
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # The head is whole classes of equal log2 count, an eighth wide, HEAD words at most; the tail is the rest.
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    head_from, size = 0, 0
    for r in vocabulary.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("l")).collect():  # 512 rows at most
        size += r.k
        if size > HEAD:
            head_from = r.l + 1
            break
    top = vocabulary.where(level >= head_from).toArrow()
    head_h, head_n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(head_h)
    whole = n <= SENT_TOKENS
    weight = room(v)
    send = spark.sparkContext.broadcast((gathered(*build_filter(train)) if whole else None, head_h[order], head_n[order]))
    denominator = float(n + v + 1)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = send.value[0]
        yield from rated(((part, texts, lm.levels) for part, texts in text_blocks(batches, "_t")))

    def rated(blocks: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        _, head, count = send.value
        for part, texts, levels in blocks:
            token, begin = tokens(texts)
            one, two = grams(token, begin)
            word, at, back = np.unique(token, return_index=True, return_inverse=True)
            place = np.minimum(np.searchsorted(head, word), max(len(head) - 1, 0))
            found = head[place] == word if len(head) else np.zeros(len(word), bool)
            exact = np.where(found, count[place] if len(head) else 0, 0).astype(np.float64)
            start = begin[:-1]
            known = np.add.reduceat(found[back].astype(np.int64), start)
            base = np.add.reduceat(np.where(found, np.log10((exact + 1) / denominator), 0.0)[back], start)
            # Words beyond the head are looked up in a join: listed with their number in the text.
            rare = np.flatnonzero(~found[back]) if head_from else np.zeros(0, np.int64)
            text = np.searchsorted(begin, rare, side="right") - 1
            if not head_from:
                base += np.add.reduceat(np.where(found, 0.0, np.log10(1 / denominator))[back], start)
            offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            held = levels(one[at])  # probes for distinct words
            uni = (LOW[held][back] + 1) / denominator
            # The history is the word before; a text's first one follows the start mark, met once a text as the end mark is.
            prior = np.empty(len(token), dtype=np.int64)
            prior[1:] = held[back][:-1]
            prior[start] = levels(END_KEY)[0]
            pair = np.minimum(levels(two), np.minimum(prior, held[back]))
            p = (LOW[pair] + MU * uni) / (HIGH[prior] + weight)
            total = np.add.reduceat(np.log10(p), start)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(np.diff(begin)), pa.array(known), pa.array(base), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), pa.array(token[rare].view(np.int64)))],
                names=["_id", "_out", "n_tokens", "n_known", "base", "score", "rare"],
            )

    result = f"_id {kind}, _out boolean, n_tokens long, n_known long, base double, score double, rare array<long>"
    scored = rows.mapInArrow(work, result) if whole else _by_buckets(rows, n, rated, result)
    if head_from:
        scored = materialize(scored.withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
        tail = vocabulary.where(level < head_from)
        wanted = scored.select("_row", F.explode("rare").alias("h")).groupBy("_row", "h").agg(F.count(F.lit(1)).alias("k"))
        found = wanted.join(tail, "h", "left").groupBy("_row").agg(
            F.sum("k").alias("_k"), F.sum(F.when(F.col("n").isNotNull(), F.col("k"))).alias("_known"),
            F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(denominator))).alias("_base"))
        scored = scored.join(found, "_row", "left").withColumn("n_known", F.col("n_known") + F.coalesce("_known", F.lit(0))).withColumn("base", F.col("base") + F.coalesce("_base", F.lit(0.0)))
    return scored.select(F.col("_id").alias(id_col), F.col("_out").alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
