"""Induced suffix sorting with common-prefix values, in bulk and with queues on disk.

A shard is a text of segments, each ended by the separator 0 (bytes are 1 to
256). The suffixes that start a rising run after a falling one (LMS) are named
by their substrings and ordered by doubling over the names. All others are
induced: scanned in order, a suffix places the one before it into the queue of
that one's first character. A queue entry is a suffix tuple, its position and
the common prefix with the entry before it; the common prefix of two induced
neighbours is one more than the least of those scanned between their sources.
Scanned entries go in batches, as numpy arrays; queues keep a bounded part in
memory and the rest in an unnamed scratch file that vanishes with the task.

Common prefixes, and the order, are only followed to ``depth`` bytes.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that the queues of a shard keep in memory.
MEMORY = 48 << 20
#: Entries of one batch.
BATCH = 1 << 20


class Queues:
    """First-in-first-out queues of (position, common prefix) by first character: a priority queue of suffix tuples.

    Beyond ``memory`` bytes, queues move to disk, longest first.
    """

    def __init__(self, characters: int, memory: int = MEMORY):
        self.parts: list[list] = [[] for _ in range(characters)]
        self.sizes = np.zeros(characters, dtype=np.int64)  # entries in memory
        self.memory, self.held, self.file = memory, 0, None

    def push(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[c].append((pos, lcp))
        self.sizes[c] += len(pos)
        self.held += 9 * len(pos)
        while self.held > self.memory:
            self._spill(int(self.sizes.argmax()))

    def _spill(self, c: int) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115  closed with the queues
        parts = self.parts[c]
        for i, p in enumerate(parts):
            if isinstance(p[0], np.ndarray):
                at = self.file.seek(0, 2)
                self.file.write(p[0].tobytes())
                self.file.write(p[1].tobytes())
                parts[i] = (at, len(p[0]))
        self.held -= 9 * int(self.sizes[c])
        self.sizes[c] = 0

    def _load(self, part) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(part[0], np.ndarray):
            return part
        self.file.seek(part[0])
        return np.frombuffer(self.file.read(8 * part[1]), dtype=np.int64), np.frombuffer(self.file.read(part[1]), dtype=np.uint8)

    def batches(self, c: int, start: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All entries of ``c`` in order, with those that arrive meanwhile, in batches; they stay."""
        at = start
        while at < len(self.parts[c]):
            group, size = [], 0
            while at < len(self.parts[c]) and size < BATCH:
                group.append(self._load(self.parts[c][at]))
                size += len(group[-1][0])
                at += 1
            yield (group[0] if len(group) == 1 else tuple(np.concatenate(x) for x in zip(*group, strict=True)))

    def reversed(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in reversed(self.parts[c]):
            pos, lcp = self._load(part)
            yield pos[::-1], lcp[::-1]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _refine(rank: np.ndarray, idx: np.ndarray, key: np.ndarray) -> None:
    """Orders whole groups of equal rank by a further key. A rank is the number of smaller items."""
    r = rank[idx]
    order = np.lexsort((key, r))
    r, k = r[order], key[order]
    group = np.concatenate([[True], r[1:] != r[:-1]])
    fresh = group | np.concatenate([[True], k[1:] != k[:-1]])
    at = np.arange(len(r))
    rank[idx[order]] = r + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))


def _tied(rank: np.ndarray) -> np.ndarray:
    count = np.bincount(rank, minlength=len(rank))
    return count[rank] > 1


class Shard:
    """Sorted suffixes of a text (uint16, segments ended by 0)."""

    def __init__(self, text: np.ndarray, depth: int, memory: int = MEMORY):
        self.t, self.n, self.depth, self.memory = text, len(text), depth, memory
        differ = np.flatnonzero(text[1:] != text[:-1])
        nxt = np.searchsorted(differ, np.arange(self.n))
        rises = np.zeros(len(differ) + 1, dtype=bool)
        rises[:-1] = text[differ] < text[differ + 1]
        self.rising = rises[nxt]  # the last run falls to the end of the text
        # Four characters a word, to compare eight bytes at a time.
        padded = np.concatenate([text, np.zeros(depth + 8, np.uint16)])
        self.words = np.ndarray((self.n + depth + 4,), dtype="<u8", buffer=padded, strides=(2,))
        self._keep = padded

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes, up to ``depth``."""
        out = np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        for d in range(0, self.depth, 4):
            if not len(live):
                break
            x = self.words[np.minimum(a[live] + d, self.n)] ^ self.words[np.minimum(b[live] + d, self.n)]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 4, np.bitwise_count(low - np.uint64(1)) // 16)
            out[live] += same
            live = live[same == 4]
        room = np.minimum(self.n - np.maximum(a, b), self.depth)
        return np.minimum(out, room)

    def _sorted_lms(self) -> tuple[np.ndarray, np.ndarray]:
        """LMS suffixes in order (to ``depth`` bytes at least) with common prefixes."""
        up = self.rising
        lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
        m = len(lms)
        if not m:
            return lms, np.zeros(0, np.uint8)
        # Names: substrings from one LMS to the next, characters with their kinds, four a word.
        size = np.diff(np.concatenate([lms, [self.n - 1]])) + 1
        coded = np.zeros(self.n + 8, dtype=np.uint16)
        coded[: self.n] = 2 * self.t + up + 1
        words = np.ndarray((self.n + 4,), dtype="<u8", buffer=coded, strides=(2,))

        def word(idx: np.ndarray, k: int) -> np.ndarray:
            w = words[np.minimum(lms[idx] + 4 * k, self.n)].byteswap()  # high byte first ...
            w = ((w & np.uint64(0x00FF00FF00FF00FF)) << np.uint64(8)) | ((w >> np.uint64(8)) & np.uint64(0x00FF00FF00FF00FF))  # ... of each character
            left = np.clip(size[idx] - 4 * k, 0, 4)
            return w & (np.uint64(0xFFFFFFFFFFFFFFFF) << (np.uint64(16) * (4 - left).astype(np.uint64) % np.uint64(64))) * (left > 0).astype(np.uint64)

        rank = np.zeros(m, dtype=np.int64)
        every = np.arange(m)
        _refine(rank, every, word(every, 0))
        for k in range(1, -(-min(int(size.max()), self.depth + 4) // 4)):
            longer = np.zeros(m, dtype=bool)
            longer[rank[size > 4 * k]] = True
            idx = np.flatnonzero(longer[rank] & _tied(rank))
            if len(idx):
                _refine(rank, idx, word(idx, k))
        # Doubling over names; 2^r names are more than 2^r bytes.
        step = 1
        while step <= self.depth:
            idx = np.flatnonzero(_tied(rank))
            if not len(idx):
                break
            nxt = idx + step
            key = np.where(nxt < m, rank[np.minimum(nxt, m - 1)] + 1, 0)
            _refine(rank, idx, key)
            step *= 2
        order = lms[np.argsort(rank, kind="stable")]
        lcp = np.zeros(m, dtype=np.uint8)
        lcp[1:] = self.common(order[:-1], order[1:])
        return order, lcp

    def _induce(self, queues: Queues, least: np.ndarray, pos: np.ndarray, lcp: np.ndarray, rising: bool) -> None:
        """Places the suffixes before a scanned batch; ``least``: by character, the least prefix since its last entry."""
        m = len(pos)
        if not m:
            return
        before = np.maximum(pos - 1, 0)
        v = np.flatnonzero((pos > 0) & (self.rising[before] == rising))
        lcp = lcp.astype(np.int64)
        tail = np.minimum.accumulate(lcp[::-1])[::-1]
        if len(v):
            c = self.t[before[v]]
            o = np.argsort(c, kind="stable")
            k, c = v[o], c[o].astype(np.int64)
            first = np.concatenate([[True], c[1:] != c[:-1]])
            begin = np.where(first, 0, np.concatenate([[0], k[:-1] + 1]))
            pairs = np.stack([begin, k + 1], axis=1).ravel()
            low = np.minimum.reduceat(np.concatenate([lcp, [self.depth]]), pairs)[::2]
            low[first] = np.minimum(low[first], least[c[first]])
            got = np.minimum(low + 1, self.depth).astype(np.uint8)
        np.minimum(least, tail[0], out=least)
        if len(v):
            cut = np.flatnonzero(first)
            ends = np.concatenate([cut[1:], [len(k)]])
            for s, e in zip(cut.tolist(), ends.tolist(), strict=True):
                queues.push(int(c[s]), before[k[s:e]], got[s:e])
                last = int(k[e - 1]) + 1
                least[c[s]] = tail[last] if last < m else self.depth

    def suffixes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of (positions, common prefix with the suffix before) in order."""
        characters = 257
        lms, lms_lcp = self._sorted_lms()
        heads = self.t[lms]
        bounds = np.searchsorted(heads, np.arange(characters + 1))
        falling, least = Queues(characters, self.memory // 2), np.full(characters, -1, dtype=np.int64)
        if self.n:
            falling.push(int(self.t[-1]), np.array([self.n - 1]), np.zeros(1, np.uint8))
            least[self.t[-1]] = 0  # nothing is in common with the empty suffix
        for c in range(characters):
            last = None
            for pos, lcp in falling.batches(c):
                self._induce(falling, least, pos, lcp, False)
                last = pos[-1:]
            s, e = bounds[c], bounds[c + 1]
            if e > s:
                lcp = lms_lcp[s:e].copy()
                lcp[0] = self.common(last, lms[s : s + 1])[0] if last is not None else 0
                self._induce(falling, least, lms[s:e], lcp, False)
        rising, least = Queues(characters, self.memory // 2), np.full(characters, -1, dtype=np.int64)
        for c in range(characters - 1, -1, -1):
            last = None
            for pos, lcp in rising.batches(c):
                self._induce(rising, least, pos, lcp, True)
                last = pos[-1:]
            carry = None  # the prefix that the entry scanned last has with the next one
            for pos, lcp in falling.reversed(c):
                now = np.empty(len(pos), dtype=np.uint8)
                now[1:] = lcp[:-1]
                now[0] = carry if carry is not None else self.common(last, pos[:1])[0] if last is not None else 0
                self._induce(rising, least, pos, now, True)
                carry = lcp[-1]
        for c in range(characters):
            last = None
            for pos, lcp in falling.batches(c):
                yield pos, lcp
                last = pos[-1:]
            carry = None
            for pos, lcp in rising.reversed(c):
                now = np.empty(len(pos), dtype=np.uint8)
                now[1:] = lcp[:-1]
                now[0] = carry if carry is not None else self.common(last, pos[:1])[0] if last is not None else 0
                yield pos, now
                carry = lcp[-1]
        falling.close()
        rising.close()
