"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every word belongs to two hash buckets, of its form and of its last bytes with
its shape. A bucket has a fixed sparse random index vector; its word vector
is the sum of the index vectors met beside it in the fitting texts, scaled to
length one. A document is the mean of its words' vectors, the mean product of
neighbouring index vectors (which repetition raises) and five plain figures.
Two dense layers in numpy give the score; a temperature fitted on labelled
rows that the layers did not see calibrates it.

Fitting uses at most ``sample`` labelled rows, picked by a hash of their ids;
scoring covers every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, runs, small_batches, text_blocks, xxh64

BUCKETS, WIDTH, NONZERO, HIDDEN = 1 << 13, 32, 4, 24
#: Labelled rows that fitting uses at most; the bound of what reaches the driver (about 4 MB).
SAMPLE = 6000
THRESHOLD = 0.3
#: Tasks that build word vectors, each with one table of 1 MB.
FIT_TASKS = 8


def index_vectors() -> np.ndarray:
    """The fixed sparse ternary vectors of the 2 x BUCKETS buckets."""
    rng = np.random.default_rng(7)
    table = np.zeros((2 * BUCKETS, WIDTH), dtype=np.float32)
    for _ in range(NONZERO):
        table[np.arange(2 * BUCKETS), rng.integers(0, WIDTH, 2 * BUCKETS)] += rng.choice([-1, 1], 2 * BUCKETS).astype(np.float32)
    return table


def _words(texts: list[bytes]):
    """Buckets of all words (form; ending and shape), their text, and plain counts a text."""
    buf, starts, ends, first = runs(texts, SPACE, fold=False)
    n = ends - starts
    form = (xxh64(buf, starts, ends, 1) % np.uint64(BUCKETS)).astype(np.int64)
    upper = (buf >= 65) & (buf <= 90)
    digit = (buf >= 48) & (buf <= 57)
    letter = upper | ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    cum = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    cu, cd, cl = cum(upper), cum(digit), cum(letter)
    ups, digits, letters = cu[ends] - cu[starts], cd[ends] - cd[starts], cl[ends] - cl[starts]
    shape = np.where(ups == 0, 0, np.where(ups == letters, 1, 2)) + 3 * (digits > 0) + 6 * (letters == 0) + 12 * np.minimum(n // 8, 3)
    tail = np.zeros(len(n), dtype=np.int64)
    for i in range(1, 4):  # of a short word, what stands there
        byte = np.where(n >= i, buf[np.maximum(ends - i, 0)], 0).astype(np.int64)
        kind = np.where((byte >= 128) | ((byte >= 97) & (byte <= 122)) | ((byte >= 65) & (byte <= 90)), 1, byte)
        tail = tail * 256 + kind
    mixed = (tail * 64 + shape).astype(np.uint64)
    with np.errstate(over="ignore"):
        ending = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BUCKETS + BUCKETS
    count = np.diff(first)
    text = np.repeat(np.arange(len(texts)), count)
    return form, ending, text, count, first[:-1], n, letters


def _context(texts: list[bytes], index: np.ndarray, table: np.ndarray) -> None:
    """Adds to the buckets' rows the index vectors of both neighbours' buckets."""
    form, ending, text, _, _, _, _ = _words(texts)
    near = np.flatnonzero(text[1:] == text[:-1])
    for a, b in ((near, near + 1), (near + 1, near)):
        v = index[form[b]] + index[ending[b]]
        for bucket in (form[a], ending[a]):
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0])) if len(order) else order
            if len(order):
                table[bucket[order][cut]] += np.add.reduceat(v[order], cut, axis=0)


def features(texts: list[bytes], index: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Pooled vectors of texts; zeros for a text without words."""
    form, ending, text, count, first, size, letters = _words(texts)
    out = np.zeros((len(texts), 3 * WIDTH + 5), dtype=np.float32)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    c = count[some][:, None].astype(np.float32)
    at = first[some]
    out[some, :WIDTH] = np.add.reduceat(vectors[form], at, axis=0) / c
    out[some, WIDTH : 2 * WIDTH] = np.add.reduceat(vectors[ending], at, axis=0) / c
    nxt = np.minimum(np.arange(len(form)) + 1, len(form) - 1)
    inside = (text[nxt] == text) & (nxt > np.arange(len(form)))
    out[some, 2 * WIDTH : 3 * WIDTH] = np.add.reduceat(index[form] * index[form[nxt]] * inside[:, None], at, axis=0) / c
    same = (inside & (form[nxt] == form)).astype(np.float32)
    key = np.unique(text * BUCKETS + form)
    distinct = np.bincount(key // BUCKETS, minlength=len(texts))[some]
    out[some, -5] = np.log1p(count[some])
    out[some, -4] = np.add.reduceat(same, at) / c[:, 0]
    out[some, -3] = distinct / c[:, 0]
    out[some, -2] = np.add.reduceat(size.astype(np.float32), at) / c[:, 0]
    out[some, -1] = np.add.reduceat(letters.astype(np.float32), at) / np.maximum(np.add.reduceat(size.astype(np.float32), at), 1)
    return out


@dataclass
class Classifier:
    """What scoring needs; about 2 MB whatever the corpus."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float

    def score(self, texts: list[bytes], index: np.ndarray) -> np.ndarray:
        return self.score_features(features(texts, index, self.vectors))

    def score_features(self, x: np.ndarray) -> np.ndarray:
        z = _logit((x - self.mean) / self.scale, self.layers) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _logit(x: np.ndarray, layers: tuple[np.ndarray, ...]) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2[0]


def _train(x: np.ndarray, y: np.ndarray, steps: int = 1500, decay: float = 1e-3) -> tuple[np.ndarray, ...]:
    """Adam on the cross entropy, whole batches of up to 1024 rows."""
    rng = np.random.default_rng(11)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, steps + 1):
        rows = rng.integers(0, len(x), 1024) if len(x) > 1024 else slice(None)
        a, b = x[rows], y[rows]
        h = np.tanh(a @ p[0] + p[1])
        g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -50, 50))) - b) / len(b)
        gh = np.outer(g, p[2]) * (1 - h * h)
        grads = [a.T @ gh + decay * p[0], gh.sum(0), h.T @ g + decay * p[2], np.array([g.sum()])]
        for i, q in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * q
            v[i] = 0.999 * v[i] + 0.001 * q * q
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def _calibrate(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least cross entropy, on a grid."""
    def loss(t: float) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(z / t, -50, 50))), 1e-9, 1 - 1e-9)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    return float(min(np.geomspace(0.25, 8, 41), key=loss)) if len(z) else 1.0


def held_out(id_col: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text (null: empty text) falls on ``fold``."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Classifier:
    """A classifier from labelled rows that are not held out.

    Labels other than 0 and 1, and null ids, are left out. Without rows of
    both classes the score is the share of 1 (0.5 without any row).
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_y"))
    picked = ranked.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(picked), "_id")  # at most ``sample`` rows
    rows = materialize(rows.repartition(FIT_TASKS, F.xxhash64("_id")), "quality-sample")

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, table = index_vectors(), np.zeros((2 * BUCKETS, WIDTH), dtype=np.float64)
        for _, texts in text_blocks(batches, "_t"):
            _context(texts, index, table)
        yield pa.RecordBatch.from_arrays([pa.array([table.astype(np.float32).tobytes()])], names=["v"])

    total = np.zeros((2 * BUCKETS, WIDTH))
    for r in rows.select("_t").coalesce(FIT_TASKS).mapInArrow(contexts, "v binary").toLocalIterator():
        total += np.frombuffer(r.v, dtype=np.float32).reshape(total.shape)
    vectors = (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    send = spark.sparkContext.broadcast(vectors)

    def pooled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        for part, texts in text_blocks(batches, "_t"):
            x = features(texts, index, send.value)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("_id")).cast(pa.string()), part.column(part.schema.get_field_index("_y")), pa.array([v.tobytes() for v in x])], names=["i", "y", "x"])

    got = sorted((r.i, r.y, r.x) for r in rows.mapInArrow(pooled, "i string, y double, x binary").collect())  # at most ``sample`` rows
    width = 3 * WIDTH + 5
    y = np.array([r[1] for r in got])
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Classifier(vectors, np.zeros(width), np.ones(width), (np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([bias])), 1.0)
    x = np.stack([np.frombuffer(r[2], dtype=np.float32) for r in got]).astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    check = np.arange(len(y)) % 5 == 4
    layers = _train(x[~check], y[~check])
    return Classifier(vectors, mean, scale, layers, _calibrate(_logit(x[check], layers), y[check]))


def classify(docs: DataFrame, model: Classifier, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``) to every row.

    Null and empty texts, and texts of blanks, have the score of a zero
    vector. Only the text is used. Columns of the added names are replaced;
    all others are kept; repeated rows get equal scores.
    """
    spark = docs.sparkSession
    small_batches(spark)
    send = spark.sparkContext.broadcast(model)
    names = ["score", "predicted"]
    kept = [c for c in docs.columns if c not in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept] + ["score double", "predicted int"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        for part, texts in text_blocks(batches, text_col):
            s = send.value.score(texts, index)
            cols = [part.column(part.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=kept + names)

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(work, schema)
