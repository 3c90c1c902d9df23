"""SentencePiece encoding and decoding with a batched numpy Viterbi.

A text becomes code points with a word mark (U+2581) for every space and one
in front; pieces hold word marks only at their start, so a text falls into
words before marks. Distinct words of equal length advance together through a
lattice: at each end position, hashes of the substrings that end there probe
the sorted piece keys, and a vectorised maximum over the start positions
stores the backpointer. An arc weighs its piece's log probability, and the best
path is the encoding.

The weights are those of a unigram model file. A BPE model file has none: its
scores only number the merges. Its pieces then get the log probabilities of
Zipf's law by that number, which is a unigram model with the same vocabulary
(``unigram``); results equal the SentencePiece library's for the model file
that ``Model.to_bytes`` writes. ``merges=True`` gives a BPE model's own
encoding instead, by carrying out its merges.

A word longer than ``LONG`` is cut where no piece of two or more characters
crosses; what is still longer goes through the same lattice alone, or through
a heap of merges, so that a text without blanks takes time in proportion to
its length.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, text_blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_MARK = ord(MARK)
#: Multipliers of the two substring hashes.
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Piece kinds of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters of a word that is encoded together with others.
LONG = 256
#: Ids that a worker keeps for words it has met, before it starts anew.
CACHE_IDS = 4_000_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: number and value (bytes, int or float)."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[i : i + n]
            i += n
        elif kind == 5:
            yield tag >> 3, struct.unpack("<f", data[i : i + 4])[0]
            i += 4
        else:
            yield tag >> 3, data[i : i + 8]
            i += 8


class Model:
    """Pieces, scores and kinds of a SentencePiece model file."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.rest: list[tuple[int, bytes]] = []  # messages other than pieces
        self.bpe, self.dummy_prefix, self.squeeze = False, True, True
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(piece[2])
                self.kinds.append(piece[3])
                continue
            self.rest.append((number, value))
            if number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                self.dummy_prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2):
                    raise ValueError("models that normalise texts are not supported")
        if self.squeeze:
            raise ValueError("models that squeeze spaces are not supported")
        if any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER)):
            raise ValueError("a piece goes across words")
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)

    def unigram(self) -> Model:
        """This model if it is a unigram one; else the unigram model of its pieces, with Zipf's law over the merges' numbers."""
        if not self.bpe:
            return self
        out = Model.__new__(Model)
        out.__dict__.update(self.__dict__)
        normal = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        rank = {i: r for r, i in enumerate(sorted(normal, key=lambda i: (-self.scores[i], i)), 1)}
        total = float(np.log(np.sum(1 / np.arange(1, len(normal) + 1))))
        out.scores = [float(np.float32(-np.log(rank[i]) - total)) if i in rank else 0.0 for i in range(len(self.pieces))]
        out.bpe = False
        return out

    def to_bytes(self) -> bytes:
        """A model file with these pieces and weights, of the unigram kind."""
        def varint(n: int) -> bytes:
            out = b""
            while n > 127:
                out, n = out + bytes([n & 127 | 128]), n >> 7
            return out + bytes([n])

        def field(number: int, data: bytes) -> bytes:
            return varint(number << 3 | 2) + varint(len(data)) + data

        parts = [field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for p, s, k in zip(self.pieces, self.scores, self.kinds, strict=True)]
        for number, value in self.rest:
            parts.append(field(number, value + varint(3 << 3) + varint(1) if number == 2 else value))  # the last value of a field counts
        return b"".join(parts)


def _hash(points: np.ndarray, base: np.uint64) -> np.ndarray:
    """Prefix hashes along the last axis, one longer than ``points``."""
    out = np.zeros((*points.shape[:-1], points.shape[-1] + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(31)
        for i in range(points.shape[-1]):
            out[..., i + 1] = out[..., i] * base + mixed[..., i]
    return out


class Codec:
    """Encoder and decoder; built once on the driver, sent to workers (its size is that of the vocabulary)."""

    def __init__(self, model: Model):
        self.model = model
        usable = [i for i, k in enumerate(model.kinds) if k in (NORMAL, USER)]
        self.longest = max((len(model.pieces[i]) for i in usable), default=1)
        length = np.array([len(model.pieces[i]) for i in usable], dtype=np.int64)
        usable = np.array(usable, dtype=np.int64)
        one, two = np.zeros(len(usable), np.uint64), np.zeros(len(usable), np.uint64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            points = np.frombuffer("".join(model.pieces[i] for i in usable[at]).encode("utf-32-le"), dtype="<u4").reshape(-1, n)
            one[at], two[at] = _hash(points, _B1)[:, -1], _hash(points, _B2)[:, -1]
        order = np.argsort(one)
        self.key1, self.key2, self.key_len, self.key_id = one[order], two[order], length[order], usable[order]
        self.weight = np.array(model.scores, dtype=np.float64)
        self.worst = min((model.scores[i] for i in usable.tolist()), default=0.0) - 10.0  # of an unknown character
        self.size = len(model.pieces)
        out = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        out[model.unknown] = " ⁇ ".encode()
        self.out = np.frombuffer(b"".join(out) or b"\0", dtype=np.uint8)
        self.out_len = np.array([len(x) for x in out], dtype=np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        power1, power2 = [1], [1]
        for _ in range(self.longest):
            power1.append(power1[-1] * int(_B1) % 2**64)
            power2.append(power2[-1] * int(_B2) % 2**64)
        self.power1, self.power2 = np.array(power1, dtype=np.uint64), np.array(power2, dtype=np.uint64)
        self.salt = 1
        self._forget()

    def _forget(self) -> None:
        self.word_check = np.zeros(0, np.uint64)
        self.word_key, self.word_at, self.word_n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _probe(self, h1: np.ndarray, h2: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Piece ids of the substrings [start, end) of the rows' words, by hash; -1: none."""
        length = end - start
        m = np.minimum(length, self.longest)
        with np.errstate(over="ignore"):
            one = h1[row, end] - h1[row, start] * self.power1[m]
            two = h2[row, end] - h2[row, start] * self.power2[m]
        at = np.minimum(np.searchsorted(self.key1, one), len(self.key1) - 1)
        found = (self.key1[at] == one) & (self.key2[at] == two) & (self.key_len[at] == length)
        return np.where(found, self.key_id[at], -1)

    def _viterbi(self, words: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Heaviest segmentation of equal-length words: flat units (ids, or size + code point if unknown) and counts."""
        n, length = words.shape
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, length + 1), dtype=np.int64)
        unit = np.full((n, length + 1), -1, dtype=np.int64)
        every = np.arange(n)
        for j in range(1, length + 1):
            starts = np.arange(max(0, j - self.longest), j)
            ids = self._probe(h1, h2, every[:, None], starts[None, :], np.full((1, len(starts)), j))
            gain = np.where(ids >= 0, self.weight[ids], -np.inf)
            lone = ids[:, -1] < 0
            gain[lone, -1] = self.worst
            ids[lone, -1] = self.size + words[lone, j - 1]
            total = best[:, starts] + gain
            pick = total.argmax(axis=1)
            best[:, j], back[:, j], unit[:, j] = total[every, pick], starts[pick], ids[every, pick]
        count = np.zeros(n, dtype=np.int64)
        chain = []
        at = np.full(n, length)
        while (live := np.flatnonzero(at > 0)).size:
            chain.append((live, unit[live, at[live]]))
            count[live] += 1
            at[live] = back[live, at[live]]
        flat = np.zeros(count.sum(), dtype=np.int64)
        end = np.cumsum(count)
        for step, (live, u) in enumerate(chain):
            flat[end[live] - 1 - step] = u
        return flat, count

    def _merged(self, words: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal-length words after all merges, best score first and leftmost of equals; as ``_viterbi``."""
        n, length = words.shape
        end = np.tile(np.arange(1, length + 2), (n, 1))  # of the part that starts here
        before = np.tile(np.arange(-1, length), (n, 1))  # start of the part that ends here
        alive = np.ones((n, length), dtype=bool)
        score = np.full((n, length), -np.inf)

        def rate(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
            ids = self._probe(h1, h2, row, start, stop)
            return np.where(ids >= 0, self.weight[ids], -np.inf)

        if length > 1:
            two = np.arange(length - 1)
            score[:, :-1] = rate(np.arange(n)[:, None], two[None, :], two[None, :] + 2)
        rows = np.arange(n)
        while len(rows):
            a = score[rows].argmax(axis=1)
            more = score[rows, a] > -np.inf
            rows, a = rows[more], a[more]
            if not len(rows):
                break
            b = end[rows, a]
            c = end[rows, b]
            end[rows, a] = c
            before[rows, c] = a
            alive[rows, b] = False
            score[rows, b] = -np.inf
            score[rows, a] = -np.inf
            right = np.flatnonzero(c < length)
            if len(right):
                r = rows[right]
                score[r, a[right]] = rate(r, a[right], end[r, c[right]])
            left = np.flatnonzero(a > 0)
            if len(left):
                r, p = rows[left], before[rows[left], a[left]]
                score[r, p] = rate(r, p, c[left])
        row, start = np.nonzero(alive)
        ids = self._probe(h1, h2, row, start, end[row, start])
        # What is no piece is a single unknown character.
        return np.where(ids >= 0, ids, self.size + words[row, start].astype(np.int64)), alive.sum(axis=1)

    def _cuts(self, points: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Starts of the parts of one word that no piece of two or more characters joins."""
        n = len(points)
        joined = np.zeros(n + 1, dtype=np.int64)
        for length in range(2, min(self.longest, n) + 1):
            start = np.arange(n - length + 1)
            hit = start[self._probe(h1, h2, np.zeros(1, np.int64), start, start + length) >= 0]
            np.add.at(joined, hit + 1, 1)
            np.add.at(joined, hit + length, -1)
        return np.flatnonzero(np.concatenate([[True], np.cumsum(joined)[1:n] == 0]))

    def _heaped(self, points: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Units of one long word after all merges, by a heap: best score first, leftmost of equals."""
        n = points.shape[1]
        start = np.arange(n - 1)
        first = self._probe(h1, h2, np.zeros(1, np.int64), start, start + 2)
        heap = [(-self.weight[p], i, i + 2, p) for i, p in zip(start[first >= 0].tolist(), first[first >= 0].tolist(), strict=True)]
        heapq.heapify(heap)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n)), bytearray(b"\1" * n)
        one = np.zeros(1, np.int64)

        def offer(a: int, c: int) -> None:
            if c - a <= self.longest:
                p = int(self._probe(h1, h2, one, np.array([a]), np.array([c]))[0])
                if p >= 0:
                    heapq.heappush(heap, (-self.weight[p], a, c, p))

        while heap:
            _, a, c, _ = heapq.heappop(heap)
            b = end[a]
            if not alive[a] or b >= c or end[b] != c:
                continue  # a part has changed since
            end[a] = c
            alive[b] = 0
            before[c] = a
            if c < n:
                offer(a, end[c])
            if a > 0:
                offer(before[a], c)
        at = np.flatnonzero(np.frombuffer(bytes(alive), dtype=np.uint8))
        ids = self._probe(h1, h2, one, at, np.array(end)[at])
        return np.where(ids >= 0, ids, self.size + points[0, at].astype(np.int64))

    def _one_long(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of one word longer than ``LONG``, as ``_viterbi``: its separate parts, equal lengths together."""
        whole = points[None, :]
        h1, h2 = _hash(whole, _B1), _hash(whole, _B2)
        begin = self._cuts(points, h1, h2)
        length = np.diff(np.concatenate([begin, [len(points)]]))
        found: list[tuple[np.ndarray, np.ndarray]] = []  # units, with the place of each part's first one kept by order
        place, count = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        total = 0
        order = np.argsort(length, kind="stable")
        for s, e in _spans(length[order]):
            n = int(length[order[s]])
            step = max(1, 2_000_000 // (n + 1))
            for f in range(s, e, step):
                rows = order[f : min(f + step, e)]
                words = points[begin[rows][:, None] + np.arange(n)]
                a, b = _hash(words, _B1), _hash(words, _B2)
                if not self.model.bpe:
                    flat, k = self._viterbi(words, a, b)
                elif n > LONG:
                    parts = [self._heaped(words[i : i + 1], a[i : i + 1], b[i : i + 1]) for i in range(len(rows))]
                    flat, k = np.concatenate(parts), np.array([len(p) for p in parts])
                else:
                    flat, k = self._merged(words, a, b)
                place[rows], count[rows] = total + np.cumsum(k) - k, k
                found.append(flat)
                total += len(flat)
        flat = np.concatenate(found)
        at = np.repeat(place - (np.cumsum(count) - count), count) + np.arange(total)
        return flat[at], np.array([total])

    def _units(self, words: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if words.shape[1] > LONG:
            parts = [self._one_long(w) for w in words]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return (self._merged if self.model.bpe else self._viterbi)(words, h1, h2)

    def _ids(self, flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces, or the unknown id, for unknown characters."""
        odd = flat >= self.size
        if not odd.any():
            return flat.astype(np.int32), count
        points, which = np.unique(flat[odd] - self.size, return_inverse=True)
        spelt = [[self.model.bytes.get(b, self.model.unknown) for b in chr(p).encode()] if self.model.bytes else [self.model.unknown] for p in points.tolist()]
        many = np.ones(len(flat), dtype=np.int64)
        many[odd] = np.array([len(x) for x in spelt])[which]
        ends = np.cumsum(many)
        out = np.repeat(flat, many)
        for i in range(4):  # the i-th byte of each
            at = np.flatnonzero(odd)[has := np.array([len(x) > i for x in spelt])[which]]
            out[ends[at] - many[at] + i] = np.array([x[i] if len(x) > i else 0 for x in spelt])[which[has]]
        total = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
        return out.astype(np.int32), np.diff(total)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        lead = MARK if self.model.dummy_prefix else ""
        marked = [(lead + t).replace(" ", MARK) if t else "" for t in (x.decode() for x in texts)]
        points = np.frombuffer("".join(marked).encode("utf-32-le"), dtype="<u4")
        text_len = np.array([len(t) for t in marked], dtype=np.int64)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        text_end = np.cumsum(text_len)
        mark = points == _MARK
        start = np.zeros(len(points), dtype=bool)
        start[1:] = mark[1:] & ~mark[:-1]
        start[(text_end - text_len)[text_len > 0]] = True
        begin = np.flatnonzero(start)
        length = np.diff(np.concatenate([begin, [len(points)]]))
        key = np.zeros(len(begin), dtype=np.uint64)
        order = np.argsort(length, kind="stable")
        check = np.zeros(len(begin), dtype=np.uint64)
        fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # keys, ids in a row, counts, second hashes
        for s, e in _spans(length[order]):
            rows, n = order[s:e], int(length[order[s]])
            step = max(1, 2_000_000 // (n + 1))
            for f in range(0, len(rows), step):
                part = rows[f : f + step]
                words = points[begin[part][:, None] + np.arange(n)]
                h1, h2 = _hash(words, _B1), _hash(words, _B2)
                with np.errstate(over="ignore"):
                    k = h1[:, -1] * _B2 ^ h2[:, -1] * np.uint64(self.salt % (1 << 64)) ^ np.uint64(n)
                key[part], check[part] = k, h2[:, -1]
                k, one = np.unique(k, return_index=True)
                if len(self.word_key):
                    at = np.minimum(np.searchsorted(self.word_key, k), len(self.word_key) - 1)
                    new = self.word_key[at] != k
                    k, one = k[new], one[new]
                if len(k):
                    fresh.append((k, *self._ids(*self._units(words[one], h1[one], h2[one])), h2[one, -1]))
        if fresh:
            k, count = np.concatenate([x[0] for x in fresh]), np.concatenate([x[2] for x in fresh])
            place = len(self.pool) + np.cumsum(count) - count
            self.pool = np.concatenate([self.pool, *[x[1] for x in fresh]])
            o = np.argsort(k)
            at = np.searchsorted(self.word_key, k[o])
            second = np.concatenate([x[3] for x in fresh])
            self.word_key, self.word_at, self.word_n, self.word_check = (np.insert(old, at, new[o]) for old, new in ((self.word_key, k), (self.word_at, place), (self.word_n, count), (self.word_check, second)))
        at = np.searchsorted(self.word_key, key)
        if (self.word_check[at] != check).any():  # two words with one key: drawn anew
            self.salt = self.salt * 2 + 1
            self._forget()
            return self.encode(texts)
        n = self.word_n[at]
        ids = self.pool[np.repeat(self.word_at[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        total = np.concatenate([[0], np.cumsum(n)])
        first = np.searchsorted(begin, np.concatenate([text_end - text_len, [len(points)]]))
        if len(self.pool) > CACHE_IDS:
            self._forget()
        return ids, total[first[1:]] - total[first[:-1]]

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """Texts of ids; the dummy prefix goes."""
        n = self.out_len[ids]
        data = self.out[np.repeat(self.out_at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])]
        texts = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [t[1:] if self.model.dummy_prefix and t[:1] == b" " else t for t in texts]


def _spans(ordered: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1, [len(ordered)]])
    return zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)


def load(path: str = MODEL, merges: bool = False) -> Codec:
    with open(path, "rb") as f:
        model = Model(f.read())
    return Codec(model if merges else model.unigram())


def encode(docs: DataFrame, path: str = MODEL, text_col: str = "text", ids_col: str = "ids", check: bool = True, merges: bool = False) -> DataFrame:
    """Adds ``ids_col`` (array of int) and, with ``check``, the decoded text's digest and whether it is the text.

    Ids are those of the heaviest path, or with ``merges`` those of a BPE model's merges.

    A null or empty text has no ids and decodes to the empty text. A word mark
    in a text decodes to a space, as in the library; ``round_trip`` says so.
    Very long texts go whole. Columns that are there already and have an added
    name are replaced; all others stay as they are. Rows stay in number.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    codec = spark.sparkContext.broadcast(load(path, merges))
    added = [(ids_col, "array<int>")] + ([("decoded_sha256", "string"), ("round_trip", "boolean")] if check else [])
    names = [n for n, _ in added]
    kept = [c for c in docs.columns if c not in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept] + [f"`{n}` {t}" for n, t in added])
    given = docs.select(*[F.col(f"`{c}`") for c in kept], *([] if text_col in kept else [F.col(f"`{text_col}`")]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec.value
        for part, texts in text_blocks(batches, text_col):
            ids, count = c.encode(texts)
            offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            more = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
            if check:
                back = c.decode(ids, count)
                more += [pa.array([hashlib.sha256(b).hexdigest() for b in back]), pa.array([a == b for a, b in zip(texts, back, strict=True)])]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(k)) for k in kept] + more, names=kept + names)

    return given.mapInArrow(work, schema)
