"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as words: lower-cased A-Z, ASCII punctuation at the edges of a word dropped. An item
of ``n`` words may differ from a passage by ``k = floor(n * ERRORS)`` word insertions, deletions or
substitutions. The item is split into ``k + 1`` pieces; a passage within ``k`` edits holds at least one
of them unchanged, so every hit of a piece's hash in a document is verified on the words around it
with Myers' bit-parallel distance, the item anywhere in the window, one machine step a word.

The items are a stated query set: they are taken in blocks of about ``BLOCK_WORDS`` words, each block
sent to all executors and held against all documents, whatever the number of blocks. Documents never move.

Defined results: items and texts without words (or null) match nothing; of equal distances the match
that ends first is returned; repeated documents or items give a row each (items that share an id
and text give one); null ids stay null; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, arrow_map, texts

ERRORS = 0.2
BLOCK_WORDS = 2_000_000
EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(EDGE) for x in text.lower().split()) if w]


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    acc = np.full(max(0, len(h) - length + 1), length, dtype=np.uint64)
    for j in range(length if len(acc) else 0):
        acc = (acc ^ (acc >> np.uint64(31))) * _STEP + h[j : j + len(acc)]
    return acc


def budget(n: int) -> int:
    return int(n * ERRORS)


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """k + 1 runs (start, length) that make up n words, of lengths that differ by at most one."""
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(pattern):
        out[w] = out.get(w, 0) | (1 << i)
    return out


def myers(peq: dict[int, int], m: int, text) -> list[int]:
    """Smallest edit distance of the pattern to a run of ``text`` ending at each word."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        out.append(score)
    return out


class Items:
    """A block of items with their pieces, by piece length, in hash order."""

    def __init__(self, rows):
        self.ids, self.sizes, self.peq, found = [], [], [], {}
        for item_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            h = hashes(words_of(text))
            if not len(h):
                continue
            at = len(self.ids)
            self.ids.append(item_id)
            self.sizes.append(len(h))
            self.peq.append(masks(h.tolist()))
            for start, length in pieces(len(h), budget(len(h))):
                found.setdefault(length, []).append((int(windows(h[start : start + length], length)[0]), at, start))
        self.pieces = {}
        for length, hits in found.items():
            hits.sort()
            self.pieces[length] = (np.array([x[0] for x in hits], dtype=np.uint64), np.array([x[1] for x in hits]), np.array([x[2] for x in hits]))

    def hits(self, h: np.ndarray):
        """(item, first word at which the whole item would begin) of each piece found in the document."""
        for length, (keys, items, starts) in self.pieces.items():
            run = windows(h, length)
            lo = np.searchsorted(keys, run, "left")
            maybe = np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == run))
            for at in maybe.tolist():
                j = int(lo[at])
                while j < len(keys) and keys[j] == run[at]:
                    yield int(items[j]), at - int(starts[j])
                    j += 1

    def matches(self, h: np.ndarray):
        """(item, distance, end) of the nearest passage of each item within its budget; end counts words."""
        around: dict[int, list[int]] = {}
        for item, begin in self.hits(h):
            around.setdefault(item, []).append(begin)
        listed = h.tolist() if around else []
        for item, begins in around.items():
            m, k, best = self.sizes[item], budget(self.sizes[item]), None
            done = 0
            for begin in sorted(set(begins)):
                lo, hi = max(0, begin - k), min(len(listed), begin + m + k)
                if hi <= done:
                    continue
                if lo < done:  # goes on from the window before
                    lo = max(0, min(lo, done - m - k))
                for at, d in enumerate(myers(self.peq[item], m, listed[lo:hi])):
                    if d <= k and (best is None or (d, lo + at) < best):
                        best = (d, lo + at)
                done = hi
            if best:
                yield item, best[0], best[1] + 1


def _searcher(sent):
    def work(cols):
        block = sent.value
        out = {"doc_id": [], "item_id": [], "distance": [], "end_word": [], "n_words": []}
        for doc_id, text in zip(cols["doc_id"].to_pylist(), texts(cols["text"]), strict=True):
            for item, distance, end in block.matches(hashes(words_of(text))):
                for name, value in zip(out, (doc_id, block.ids[item], distance, end, block.sizes[item]), strict=True):
                    out[name].append(value)
        return out if out["doc_id"] else None

    return work


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, distance, end_word, n_words: the nearest passage of each item in each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * block_words)))
    found = None
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        sent = spark.sparkContext.broadcast(Items(list(zip(mine.column(0).to_pylist(), (t.encode() for t in mine.column(1).to_pylist()), strict=True))))
        part = arrow_map(docs, "doc_id long, item_id long, distance int, end_word long, n_words int", _searcher(sent))
        found = part if found is None else found.unionByName(part)
    return found


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item (rows without id all stay)."""
    leaked = Stages(spark, "leaks").keep(matches(spark, docs, items).select("doc_id").distinct(), "leaked")
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)
