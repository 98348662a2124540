"""Maximal repeats from an enhanced suffix array.

The suffix array comes from prefix doubling; the ranks of every doubling step are kept, so common
prefixes of neighbours are read off them (suffixes of short texts are sorted as they are). A stack scan over the prefix lengths walks the tree of
common-prefix intervals; an interval whose occurrences are preceded by different bytes cannot be
extended to the left, and its string is a maximal repeat with all its occurrences, not just
neighbouring ones.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, depth: int):
    """(order, ranks per doubling step) of suffixes compared up to at least ``depth`` symbols."""
    _, rank = np.unique(symbols, return_inverse=True)
    steps, width = [rank.astype(np.int64)], 1
    while width < depth and steps[-1].max(initial=0) + 1 < len(symbols):
        rank = steps[-1]
        after = np.full(len(rank), -1, dtype=np.int64)
        after[:-width] = rank[width:]
        key = rank * (len(rank) + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(len(rank), dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        steps.append(new)
        width *= 2
    return np.argsort(steps[-1], kind="stable"), steps


def common_prefixes(order: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in order (0 for the first)."""
    size = len(order)
    i, j = order[1:].copy(), order[:-1].copy()
    out = np.zeros(len(i), dtype=np.int64)
    alive = np.arange(len(i))
    top = len(steps) - 1
    while len(alive):  # whole steps of the widest rank, in case equal runs are longer than it
        a, b = i[alive], j[alive]
        ok = (a < size) & (b < size)
        ok[ok] = steps[top][a[ok]] == steps[top][b[ok]]
        alive = alive[ok]
        i[alive] += 1 << top
        j[alive] += 1 << top
        out[alive] += 1 << top
    for level in range(top - 1, -1, -1):
        ok = (i < size) & (j < size)
        ok[ok] = steps[level][i[ok]] == steps[level][j[ok]]
        i[ok] += 1 << level
        j[ok] += 1 << level
        out[ok] += 1 << level
    return np.concatenate([[0], out])


def intervals(lcp: np.ndarray, least: int):
    """(length, left, right) of every common-prefix interval of at least ``least``, children before parents."""
    stack: list[tuple[int, int]] = []
    for at in [*np.flatnonzero(lcp >= least).tolist(), len(lcp)]:
        if at == len(lcp) or lcp[at - 1] < least:  # a run of long prefixes begins here: the former has ended
            while stack:
                length, left = stack.pop()
                yield length, left, end
        if at == len(lcp):
            return
        now, left = int(lcp[at]), at - 1
        while stack and stack[-1][0] > now:
            length, left = stack.pop()
            yield length, left, at - 1
        if not stack or stack[-1][0] < now:
            stack.append((now, left))
        end = at


def _laid_out(texts: list[bytes], least: int):
    """Texts one after another, each closed by a symbol of its own: (starts, order, lcp, symbol before each suffix)."""
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    symbols = np.empty(int(starts[-1]), dtype=np.int64)
    for n, t in enumerate(texts):
        symbols[starts[n] : starts[n] + len(t)] = np.frombuffer(t, dtype=np.uint8)
        symbols[starts[n] + len(t)] = 256 + n
    order, steps = suffix_array(symbols, max(least, max(map(len, texts))))
    before = np.full(len(symbols), -1, dtype=np.int64)
    before[1:] = symbols[:-1]
    return starts, order, common_prefixes(order, steps), before


def _short_laid_out(texts: list[bytes], least: int):
    """As ``_laid_out``, of the suffixes of at least ``least`` bytes only (no others begin a repeat), for texts not much longer than that."""
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    suffixes = [t[p:] for t in texts for p in range(len(t) - least + 1)]
    at = np.concatenate([np.arange(a, a + max(0, len(t) - least + 1)) for a, t in zip(starts.tolist(), texts, strict=False)])
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    before = np.full(int(starts[-1]), -1, dtype=np.int64)
    before[1:] = np.frombuffer(b"\0".join(texts), dtype=np.uint8)
    before[starts[:-1]] = -1
    if len(order) < 2:
        return starts, at[order], np.zeros(len(order), dtype=np.int64), before
    ranked = [suffixes[i] for i in order]
    sizes = np.fromiter(map(len, ranked), dtype=np.int64, count=len(ranked))
    width = int(sizes.max())
    grid = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in ranked]), dtype=np.uint8).reshape(-1, width)
    apart = grid[1:] != grid[:-1]
    lcp = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
    return starts, at[order], np.concatenate([[0], np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1]))]), before


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, offset), ...]) of every maximal repeat of at least ``least`` bytes in the texts.

    No repeat crosses a text's end; each group lists all occurrences in order."""
    if not texts:
        return []
    starts, order, lcp, before = _laid_out(texts, least)
    ends = starts[1:] - 1
    out = []
    for length, left, right in intervals(lcp, least):
        at = order[left : right + 1]
        came = before[at]
        edge = (came < 0) | (came >= 256)
        if not edge.any() and (came == came[0]).all():
            continue  # every occurrence can be extended to the left
        at = np.sort(at)
        which = np.searchsorted(ends, at)
        out.append((length, list(zip(which.tolist(), (at - starts[which]).tolist(), strict=True))))
    return out


_DIVERSE = -2


def later_occurrences(texts: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """(text, start, stop): the bytes of all occurrences but the first of each maximal repeat, as united ranges.

    The same stack scan; an interval hands its parent only its first occurrence, for the others
    already go in a longer repeat, so the work is linear in the suffixes however deep the tree is."""
    if not texts:
        return []
    short = max(map(len, texts)) <= 4 * least
    starts, order, lcp, before = (_short_laid_out if short else _laid_out)(texts, least)
    cover = np.zeros(int(starts[-1]) + 1, dtype=np.int64)
    spots, lengths = [], []

    def close(node) -> tuple[int, int]:
        length, members, came = node
        first = min(members)
        if came == _DIVERSE:
            rest = [m for m in members if m != first]
            spots.extend(rest)
            lengths.extend([length] * len(rest))
        return first, came

    long_ = np.flatnonzero(lcp >= least)
    for run in np.split(long_, np.flatnonzero(np.diff(long_) > 1) + 1) if len(long_) else ():
        leaves = order[run[0] - 1 : run[-1] + 1]
        lefts = before[leaves]
        lefts = np.where((lefts < 0) | (lefts >= 256), _DIVERSE, lefts).tolist()
        leaves, heights = leaves.tolist(), lcp[run].tolist()
        stack: list[list] = []
        for n, first in enumerate(leaves):
            came = lefts[n]
            now = heights[n] if n < len(heights) else 0
            while stack and stack[-1][0] > now:
                top = stack.pop()
                top[1].append(first)
                if top[2] != came:
                    top[2] = _DIVERSE
                first, came = close(top)
            if not now:
                break
            if stack and stack[-1][0] == now:
                stack[-1][1].append(first)
                if stack[-1][2] != came:
                    stack[-1][2] = _DIVERSE
            else:
                stack.append([now, [first], came])
    if not spots:
        return []
    np.add.at(cover, spots, 1)
    np.add.at(cover, np.asarray(spots) + np.asarray(lengths), -1)
    inside = np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)])
    edges = np.flatnonzero(np.diff(inside))
    begin, stop = edges[::2], edges[1::2]
    which = np.searchsorted(starts, begin, "right") - 1
    return list(zip(which.tolist(), (begin - starts[which]).tolist(), (stop - starts[which]).tolist(), strict=True))
