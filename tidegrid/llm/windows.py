"""Content-defined grouping of all substrings of one length.

The least-hash k-gram inside a window of ``span`` bytes depends on the window's
bytes alone, so equal windows choose it at the same place. Consecutive windows
that choose the same k-gram form a piece; every window of a text is in exactly
one piece, and all windows that are equal, anywhere, are in pieces with equal
k-grams.
"""

from __future__ import annotations

import numpy as np

from .common import xxh64

#: Bytes of the k-gram; a multiple of 8.
GRAM = 32
_POS_BITS = 28
_M = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)]


def pieces(texts: list[bytes], span: int, gram: int = GRAM):
    """Pieces of all texts: text number, first and last window start in it, k-gram hash, content hash.

    Arrays in text order. Texts shorter than ``span`` have none. The content
    is the bytes from the first window's start to the last one's end.
    """
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    total = int(lens.sum())
    buf = np.frombuffer(b"".join(texts) + b"\0" * (span + 32), dtype=np.uint8)
    none = np.zeros(0, np.int64)
    if total < span:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), buf, np.zeros(0, np.int64)
    if total >= 1 << _POS_BITS:
        raise ValueError("cut long texts with ``sections``")
    w8 = np.ndarray((total + span,), dtype="<u8", buffer=buf, strides=(1,))
    with np.errstate(over="ignore"):
        n = total + span - gram
        h = w8[:n] * _M[0]
        for i in range(1, gram // 8):
            h ^= h >> np.uint64(29)
            h += w8[8 * i : 8 * i + n]
            h *= _M[i % len(_M)]
        h ^= h >> np.uint64(32)
        h *= _M[1]
        h ^= h >> np.uint64(29)
    low = np.uint64((1 << _POS_BITS) - 1)
    best = (h & ~low) | np.arange(n, dtype=np.uint64)
    width, want = 1, span - gram + 1
    while width * 2 <= want:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < want:
        best = np.minimum(best[: len(best) - (want - width)], best[want - width :])
    chosen = (best & low).astype(np.int64)
    ends = np.cumsum(lens)
    good = np.zeros(len(chosen) + 1, dtype=np.int8)
    long = lens >= span
    good[(ends - lens)[long]] += 1
    good[(ends - span + 1)[long]] -= 1
    good = np.cumsum(good[:-1]).astype(bool)
    start = good.copy()
    start[1:] &= (chosen[1:] != chosen[:-1]) | ~good[:-1]
    start[(ends - lens)[long]] = True
    s = np.flatnonzero(start)
    stop = good.copy()
    stop[:-1] &= ~good[1:] | start[1:]
    e = np.flatnonzero(stop)
    text = np.searchsorted(ends, s, side="right")
    origin = (ends - lens)[text]
    return text, s - origin, e - origin, h[chosen[s]], xxh64(buf, s, e + span, 8), buf, s


def sections(texts: list[bytes], span: int, size: int):
    """``(text number, offset, bytes)`` of stretches of about ``size`` bytes that hold every window of every text once.

    Neighbouring stretches of a long text share ``span - 1`` bytes. A piece may
    be cut in two there; its windows keep their k-gram, so equal windows still
    meet.
    """
    for i, t in enumerate(texts):
        if len(t) <= 2 * size:
            yield i, 0, t
            continue
        for at in range(0, len(t) - span + 1, size):
            yield i, at, t[at : at + size + span - 1]
