"""Winnowed anchors of a text: each window of ``LENGTH`` bytes is owned by one ``GRAM``-byte run in it."""

from __future__ import annotations

import numpy as np

LENGTH, GRAM = 100, 32
_BLOCK = 1 << 18
_R = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_R, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_UP = _powers(_R, _BLOCK + 2 * LENGTH)
_DOWN = _powers(_INVERSE, _BLOCK + 2 * LENGTH)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM):
    """(gram hash, context hash, position, windows before it, windows owned less one) arrays.

    Windows choose the smallest gram hash inside them, leftmost on ties, so equal windows choose the
    same gram at the same offset. An anchor's context is all its windows together: the bytes from the
    first window's start to the last one's end. Long texts go block by block."""
    n = len(text) - length + 1
    if n <= 0:
        return None
    data = np.frombuffer(text, dtype=np.uint8)
    span = length - gram + 1
    parts = []
    for at in range(0, n, _BLOCK):
        count = min(_BLOCK, n - at)
        piece = data[at : at + count + length - 1]
        prefix = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _UP[: len(piece)], out=prefix[1:])
        grams = len(piece) - gram + 1
        h = _mix((prefix[gram:] - prefix[:grams]) * _DOWN[:grams])
        low, where = h, np.arange(grams, dtype=np.int32)
        width = 1
        while width < span:
            step = min(width, span - width)
            left = low[:-step] <= low[step:]
            where = np.where(left, where[:-step], where[step:])
            low = np.where(left, low[:-step], low[step:])
            width += step
        where = where[:count]
        first = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1])
        last = np.append(first[1:], count) - 1
        own = where[first]
        context = (prefix[last + length] - prefix[first]) * _DOWN[first]
        before = own - first
        context = _mix(context + ((before.astype(np.uint64) << np.uint64(8)) + (last - first).astype(np.uint64)) * np.uint64(0xA24BAED4963EE407))
        parts.append((h[own], context, own + np.int64(at), before, last - first))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def window_hashes(data: bytes, length: int = LENGTH) -> np.ndarray:
    """64-bit hash of every window of ``length`` bytes of a short string."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) < length:
        return np.empty(0, dtype=np.uint64)
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _UP[: len(raw)], out=prefix[1:])
    n = len(raw) - length + 1
    return _mix((prefix[length:] - prefix[:n]) * _DOWN[:n])
