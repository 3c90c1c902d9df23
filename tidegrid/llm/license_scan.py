"""Licence scan with a positional index of rare tokens.

Licence words get an inverse document frequency from all files. The index maps
a word to its postings: templates and the positions where the word stands. A
file's licence words of the highest frequency weight are looked up; each of
their hits gives a template's start in the file, and the hits of one template
are intersected by that start. A short phrase must stand whole: the starts of
all its words, rarest first, are intersected exactly. For a licence text starts
may drift by a few words from hit to hit, so that words can be missing, changed
or added, but several different rare words must agree. Where they do, the
mandatory key phrase must stand whole, and a weighted share of the text's words
must stand in order of magnitude where the text lies.

All of this looks at one file's own words: hits are tied to files before starts
are computed, so a result depends neither on the rows beside a file nor on how
rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_class, runs, small_batches, text_blocks, xxh64
from .license_texts import NOTICES, TEXTS

#: What ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` leaves out of lower-cased text.
BREAK = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Base phrases and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Rare words of a text that a file is searched by (the rarest of those it has), and how many different ones must agree.
ANCHORS, AGREE = 12, 3
#: Words by which starts of neighbouring hits may differ.
DRIFT = 12
#: Weighted share of a text's words that must stand there.
SHARE = 0.75


def words_of(text: str) -> list[str]:
    """A template's words, cut as a file's are."""
    buf, starts, ends, _ = runs([text.encode()], BREAK)
    data = buf.tobytes()
    return [data[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


@dataclass
class Index:
    """Templates as word numbers, with their postings; some kilobytes."""

    vocabulary: list[str]
    keys: np.ndarray  # sorted hashes of the vocabulary
    numbers: np.ndarray
    phrases: list[tuple[np.ndarray, str, bool]]  # words, label, whether a base one
    texts: list[tuple[np.ndarray, str, np.ndarray]]  # words, label, words of the key phrase
    idf: np.ndarray

    @classmethod
    def of(cls, phrases: dict[str, str], notices: dict[str, str], texts: list[tuple[str, str, str]]) -> Index:
        cut = [(words_of(t), label, words_of(key)) for label, key, t in texts]
        short = [(words_of(p), label, base) for given, base in ((phrases, True), (notices, False)) for p, label in given.items()]
        words = sorted({w for t, _, key in cut for w in (*t, *key)} | {w for t, _, _ in short for w in t})
        data = " ".join(words).encode() + b"\0" * 32
        buf = np.frombuffer(data, dtype=np.uint8)
        n = np.array([len(w.encode()) for w in words], dtype=np.int64)
        starts = np.cumsum(n + 1) - n - 1
        h = xxh64(buf, starts, starts + n) if len(words) else np.zeros(0, np.uint64)
        order = np.argsort(h)
        number = {w: i for i, w in enumerate(words)}
        numbered = lambda t: np.array([number[w] for w in t], dtype=np.int64)
        return cls(words, h[order], order, [(numbered(t), x, b) for t, x, b in short], [(numbered(t), x, numbered(k)) for t, x, k in cut], np.ones(len(words)))

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary numbers (-1: other) of all words, and each text's first word."""
        buf, starts, ends, first = runs(texts, BREAK)
        if not len(self.keys):
            return np.full(len(starts), -1), first
        h = xxh64(buf, starts, ends)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.numbers[at], -1), first


def word_frequencies(docs: DataFrame, index: Index, text_col: str) -> tuple[np.ndarray, int]:
    """Files that hold each licence word, over all files, and their number."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, files = np.zeros(len(index.vocabulary), dtype=np.int64), 0
        for _, texts in text_blocks(batches, "_t"):
            ids, first = index.words(texts)
            hit = np.flatnonzero(ids >= 0)
            file = np.searchsorted(first, hit, side="right") - 1
            df += np.bincount(np.unique(file * len(df) + ids[hit]) % len(df), minlength=len(df))
            files += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(df))]), pa.array([files, *df.tolist()])], names=["w", "n"])

    counts = docs.select(F.col(text_col).alias("_t")).mapInArrow(work, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    found = {r.w: r.n for r in counts.collect()}  # a row for each vocabulary word
    return np.array([found.get(i, 0) for i in range(len(index.vocabulary))]), found.get(-1, 0)


def _places(index: Index, phrase: np.ndarray, hit: np.ndarray, word: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where a phrase's words stand one after another within a file: starts by word, rarest first, intersected."""
    start = None
    for k in np.argsort(-index.idf[phrase], kind="stable"):
        own = hit[word == phrase[k]] - k
        start = own if start is None else start[np.isin(start, own, assume_unique=True)]
        if not len(start):
            return start
    # All its words are hits, so the start is one; the phrase must end in the same file.
    return start[last[np.searchsorted(hit, start)] - start >= len(phrase)]


def _aligned(index: Index, number: int, hit: np.ndarray, word: np.ndarray, file: np.ndarray, files: int) -> list[tuple[int, int, int]]:
    """Stretches ``(file, first start, last start)`` where enough rare words of a text agree on its start."""
    text = index.texts[number][0]
    own = np.unique(text)
    own = own[np.argsort(-index.idf[own], kind="stable")]  # ties by number: by the alphabet
    rank = np.full(len(index.vocabulary), -1)
    rank[own] = np.arange(len(own))
    at = np.flatnonzero(rank[word] >= 0)
    if not len(at):
        return []
    # A file's rarest words of this text: the first ANCHORS that it has.
    has = np.zeros((files, len(own)), dtype=bool)
    has[file[at], rank[word[at]]] = True
    anchor = has & (np.cumsum(has, axis=1) <= ANCHORS)
    enough = anchor.sum(axis=1) >= min(AGREE, len(own))
    at = at[anchor[file[at], rank[word[at]]] & enough[file[at]]]
    if not len(at):
        return []
    # Postings: every position of the word in the text gives a start.
    order = np.argsort(text, kind="stable")
    low, high = np.searchsorted(text[order], word[at], side="left"), np.searchsorted(text[order], word[at], side="right")
    n = high - low
    which = np.repeat(at, n)
    position = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    start, f, w = hit[which] - position, file[which], word[which]
    o = np.lexsort((start, f))
    start, f, w = start[o], f[o], w[o]
    cut = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (start[1:] - start[:-1] > DRIFT)]))
    ends = np.concatenate([cut[1:], [len(start)]])
    group = np.repeat(np.arange(len(cut)), ends - cut)
    different = np.bincount(np.unique(group * len(rank) + w) // len(rank), minlength=len(cut))
    good = different >= min(AGREE, len(own))
    return list(zip(f[cut[good]].tolist(), start[cut[good]].tolist(), start[ends[good] - 1].tolist(), strict=True))


def _scan(index: Index, texts: list[bytes]):
    ids, first = index.words(texts)
    files = len(texts)
    out = {"n_words": np.diff(first), "n_base": np.zeros(files, np.int64), "first": np.full(files, np.iinfo(np.int64).max), "last": np.full(files, -1), "score": np.zeros(files)}
    base, every = [set() for _ in texts], [set() for _ in texts]
    hit = np.flatnonzero(ids >= 0)
    word, file = ids[hit], np.searchsorted(first, hit, side="right") - 1
    end = first[file + 1]
    for phrase, label, is_base in index.phrases:
        start = _places(index, phrase, hit, word, end)
        at = np.searchsorted(first, start, side="right") - 1
        out["score"][at] = 1.0
        for f in np.unique(at).tolist():
            every[f].add(label)
            if is_base:
                base[f].add(label)
        if is_base:
            np.add.at(out["n_base"], at, 1)
            np.minimum.at(out["first"], at, start - first[at])
            np.maximum.at(out["last"], at, start - first[at])
    for number, (text, label, key) in enumerate(index.texts):
        found = _aligned(index, number, hit, word, file, files)
        if not found:
            continue
        key_at = _places(index, key, hit, word, end)
        own, want = np.unique(text, return_counts=True)
        weight = index.idf[own]
        whole = float((weight * want).sum())
        for f, low, high in found:
            a, b = max(int(first[f]), low - DRIFT), min(int(first[f + 1]), high + len(text) + DRIFT)
            k = np.searchsorted(key_at, a)
            if k == len(key_at) or key_at[k] + len(key) > b:
                continue
            inside = word[np.searchsorted(hit, a) : np.searchsorted(hit, b)]
            count = np.bincount(inside, minlength=len(index.idf))[own]
            share = float((weight * np.minimum(count, want)).sum()) / whole
            if share >= SHARE:
                every[f].add(label)
            out["score"][f] = max(out["score"][f], min(share, 1.0))
    return out, base, every


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, texts: list[tuple[str, str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence phrases, notices and texts in every row's whole text.

    Returns ``id_col, n_words, n_base, first_word, last_word, base_labels,
    labels, score``. ``n_base`` counts all places of base phrases, the words
    from 0; ``score`` is 1 where a phrase or notice stands, else the best
    weighted share of a licence text whose key phrase stands (0 for none). Of
    words equally rare the alphabet decides. Null texts count as
    empty: no words, null places, empty labels, score 0. Overlapping places
    all count. Repeated rows repeat; other columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    index = Index.of(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices, TEXTS if texts is None else texts)
    df, files = word_frequencies(docs, index, text_col)
    index.idf = np.log((files + 1) / (df + 1)) + 1e-3
    send = spark.sparkContext.broadcast(index)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches, "_t"):
            out, base, every = _scan(send.value, texts)
            none = out["n_base"] == 0
            join = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(out["n_words"]), pa.array(out["n_base"]), pa.array(out["first"], mask=none), pa.array(out["last"], mask=none), join(base), join(every), pa.array(out["score"])],
                names=["_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    out = rows.mapInArrow(work, f"_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return out.withColumnRenamed("_id", id_col)
