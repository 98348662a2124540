"""Removal of byte strings of ``LENGTH`` or more that occur earlier.

1. Every window of ``LENGTH`` bytes is owned by one winnowed anchor inside it (``anchors.py``): equal
   windows have equal anchors at equal offsets, so windows need only be compared within a group of
   anchors with one hash, and a document yields an anchor per 30 bytes or so, never a row per byte.
2. Anchors whose hash occurs twice bring their context, the bytes of all windows they own, which is cut
   from the text once a document. Contexts that are the same bytes as an earlier one met in the same
   task repeat it whole and go no further; so a passage that much of the corpus shares sends a few
   contexts a task.
3. A group's contexts meet in an enhanced suffix array whose common-prefix intervals give the maximal
   repeats with all occurrences; all but the first occurrence are removed. A group of more than ``GROUP``
   contexts, which one task might not hold, is first made distinct by its bytes and then halved, again and
   again: windows that begin well before the anchor all hold the bytes before it, the others the bytes
   after it, so each half is keyed by a longer string than the anchor. Halves are groups like any other.
4. Ranges are united per document and cut from the text.

Hashes only bring strings together; whatever is removed was compared byte by byte.

Defined results: a null text is empty; a text shorter than ``LENGTH`` stays; a null id counts as the largest
and stays null; equal rows are one document, each returned with the same result; rows that share an id but
not the text are documents of their own, in order of a hash of the text; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import GRAM, LENGTH, anchors
from .common import Stages, arrow_map, texts
from .repeats import later_occurrences

GROUP = 4096
NULL_ID = 2**63 - 1
_BATCH_BYTES = 1 << 18
_TEXT_BYTES = 1 << 23
_ROWS = 1 << 16


def _united(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(batches):
    """Distinct documents (id, u, text) in order, in blocks of about ``_TEXT_BYTES`` of text."""
    held, size = {}, 0
    for batch in batches:
        for doc_id, u, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = text.as_py()
            held[doc_id, u] = text.encode() if isinstance(text, str) else text
            size += len(held[doc_id, u])
            if size >= _TEXT_BYTES:
                yield [(*k, held[k]) for k in sorted(held)]
                held, size = {}, 0
    if held:
        yield [(*k, held[k]) for k in sorted(held)]


_FOUND = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("u", pa.int64()), ("at", pa.int64()), ("stop", pa.int64())])


def _anchor_rows(length: int):
    """(id, u, text) -> anchors (h, id, u, at: position, windows before it and windows owned less one; stop 0), without
    those whose context is, byte by byte, one met before in the block; these give ranges (at, stop)."""

    def run(batches):
        for block in _blocks(batches):
            found = [(n, a) for n, a in ((n, anchors(t, length)) for n, (_, _, t) in enumerate(block)) if a is not None]
            if not found:
                continue
            h, c, at, before, more = (np.concatenate(x) for x in zip(*(a for _, a in found), strict=True))
            doc = np.repeat([n for n, _ in found], [len(a[0]) for _, a in found])
            start, stop = at - before, at - before + more + length
            order = np.lexsort((c, h))  # ties keep the order of the documents
            same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))[same]
            gone, spans = np.zeros(len(h), dtype=bool), {}
            for x, y in zip(order[head].tolist(), order[same].tolist(), strict=True):
                lo, hi, n = int(start[y]), int(stop[y]), int(doc[y])
                if block[doc[x]][2][start[x] : stop[x]] == block[n][2][lo:hi]:
                    gone[y] = True
                    spans.setdefault(n, []).append((lo, hi))
            ids, us = np.array([x[0] for x in block]), np.array([x[1] for x in block])
            left = ~gone
            columns = [h[left].view(np.int64), ids[doc[left]], us[doc[left]], (at << 16 | before << 8 | more)[left], np.zeros(int(left.sum()), dtype=np.int64)]
            whole = [(ids[n] ^ us[n], ids[n], us[n], a, b) for n, own in spans.items() for a, b in _united(own)]
            if whole:
                columns = [np.concatenate([x, np.array(y, dtype=np.int64)]) for x, y in zip(columns, zip(*whole, strict=True), strict=True)]
            for lo in range(0, len(columns[0]), _ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + _ROWS], pa.int64()) for x in columns], schema=_FOUND)

    return run


def _shared(batches):
    """Rows in order of (h, stop): ranges, and anchors whose hash another anchor has. Holds back one row between batches."""
    last, out = None, True  # the last row, and whether it has gone out
    for batch in batches:
        if not batch.num_rows:
            continue
        h, anchor = batch.column(0).to_numpy(), batch.column(4).to_numpy() == 0
        same = np.zeros(len(h) + 1, dtype=bool)  # as the row before
        same[1:-1] = (h[1:] == h[:-1]) & anchor[1:] & anchor[:-1]
        same[0] = last is not None and anchor[0] and last.column(4)[0].as_py() == 0 and last.column(0)[0].as_py() == h[0]
        if same[0] and not out:
            yield last
        keep = ~anchor | same[:-1] | same[1:]
        yield batch.filter(pa.array(keep))
        last, out = batch.slice(len(h) - 1), bool(keep[-1])


def _contexts(length: int):
    """(id, u, anchors (h, at), text) -> (h, id, u, start, before, bytes); those that equal an earlier one of the batch give ranges (start, stop) instead."""
    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("u", pa.int64()), ("start", pa.int64()), ("before", pa.int32()), ("bytes", pa.binary()), ("stop", pa.int64())])

    def rows(block):
        met = set()
        for doc_id, u, found, text in block:
            spans = []
            for at, h in sorted(zip(*found, strict=True)):
                before, size = at >> 8 & 255, (at & 255) + length
                start = (at >> 16) - before
                data = text[start : start + size]
                if (h, data) in met:
                    spans.append((start, start + size))
                else:
                    met.add((h, data))
                    yield h, doc_id, u, start, before, data, 0
            for a, b in _united(spans):
                yield doc_id ^ u, doc_id, u, a, 0, None, b

    def run(batches):
        for batch in batches:
            at, h = (batch.column(2).flatten().field(n).to_pylist() for n in ("at", "h"))
            cuts = batch.column(2).offsets.to_pylist()
            base = cuts[0]
            block = {}
            for n, (doc_id, u, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(3)), strict=True)):
                block[doc_id, u] = (doc_id, u, (at[cuts[n] - base : cuts[n + 1] - base], h[cuts[n] - base : cuts[n + 1] - base]), text)
            out = []
            for row in rows(block[k] for k in sorted(block)):
                out.append(row)
                if len(out) == _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


_RANGES = pa.schema([("id", pa.int64()), ("u", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _group_repeats(length: int):
    """Rows in order of h: ranges (id, u, start, stop) of all but the first occurrence of each maximal repeat."""

    def ranges(groups):
        first: dict = {}
        for h, *row in sorted(groups):  # in order of the documents, so the first occurrence is the earliest
            at = first.setdefault((h, row[3]), row)
            if at[:3] != row[:3]:
                yield row[0], row[1], row[2], row[2] + len(row[3])
        several: dict = {}
        for h, _ in first:
            several[h] = several.get(h, 0) + 1
        left = sorted(row for (h, _), row in first.items() if several[h] > 1)
        for n, start, stop in later_occurrences([r[3] for r in left], length):
            yield left[n][0], left[n][1], left[n][2] + start, left[n][2] + stop

    def batch_of(groups):
        out = list(ranges(groups))
        return [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=_RANGES)] if out else []

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in range(5)), strict=True):
                if row[0] != last and size >= _BATCH_BYTES:
                    yield from batch_of(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        yield from batch_of(held)

    return run


def _halves(length: int):
    """Contexts (h, lo, hi: range of the distance from a window's start to the anchor, ...) as one or two of half the range."""

    def work(cols):
        out = {k: [] for k in ("h", "id", "u", "start", "before", "bytes", "lo", "hi")}
        for doc_id, u, start, before, data, lo, hi in zip(*(cols[k].to_pylist() for k in ("id", "u", "start", "before", "bytes", "lo", "hi")), strict=True):
            mid = (lo + hi) // 2
            least = before - (len(data) - length)  # the last window's distance
            for a, b in ((lo, mid), (mid + 1, hi)):
                far, near = min(before, b), max(least, a)
                if a > b or far < near:
                    continue
                part = data[before - far : before - near + length]
                key = data[before - a : before - b + length]
                out["h"].append(xxhash.xxh3_64_intdigest(key, seed=a * 256 + b) - 2**63)
                for k, x in zip(list(out)[1:], (doc_id, u, start + before - far, far, part, a, b), strict=True):
                    out[k].append(x)
        return out

    return work


def _cut(cols):
    out = {"doc_id": cols["doc_id"], "n_bytes": [], "n_removed": [], "spans": [], "kept": []}
    for text, spans in zip(texts(cols["text"]), cols["spans"].to_pylist(), strict=True):
        spans = _united((x["start"], x["stop"]) for x in spans or ())
        keep, at = [], 0
        for a, b in spans:
            keep.append(text[at:a])
            at = b
        keep.append(text[at:])
        out["n_bytes"].append(len(text))
        out["n_removed"].append(sum(b - a for a, b in spans))
        out["spans"].append([{"start": a, "stop": b} for a, b in spans])
        out["kept"].append(b"".join(keep))
    return out


def _trees(contexts: DataFrame, length: int) -> DataFrame:
    """Ranges of groups of contexts (h, id, u, start, bytes), a group in one task."""
    return contexts.select("h", "id", "u", "start", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(_group_repeats(length), "id long, u long, start long, stop long")


def removed_ranges(stages: Stages, rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, u, start, stop (bytes) of rows (id, u: tells documents of one id apart, text)."""
    found = rows.mapInArrow(_anchor_rows(length), "h long, id long, u long, at long, stop long")
    shared = stages.keep(found.repartition("h").sortWithinPartitions("h", "stop").mapInArrow(_shared, found.schema), "shared")
    out = [shared.filter("stop > 0").select("id", "u", F.col("at").alias("start"), "stop")]
    lists = shared.filter("stop = 0").groupBy("id", "u").agg(F.collect_list(F.struct("at", "h")).alias("found"))
    contexts = lists.join(rows, ["id", "u"]).select("id", "u", "found", "text")
    contexts = stages.keep(contexts.mapInArrow(_contexts(length), "h long, id long, u long, start long, before int, bytes binary, stop long"), "contexts")
    out.append(contexts.filter("stop > 0").select("id", "u", "start", "stop"))
    contexts = contexts.filter("stop = 0").drop("stop").withColumn("lo", F.lit(0)).withColumn("hi", F.lit(length - GRAM))
    while True:
        sizes = stages.keep(contexts.groupBy("h").agg(F.count("*").alias("n")).filter(f"n > {GROUP}").select("h"), "sizes")
        if sizes.isEmpty():
            out.append(_trees(contexts, length))
            break
        out.append(_trees(contexts.join(sizes, "h", "left_anti"), length))
        large = contexts.join(sizes, "h")
        at = F.struct("id", "u", "start")
        firsts = stages.keep(large.groupBy("h", "lo", "hi", "before", "bytes").agg(F.min(at).alias("first")), "firsts")
        out.append(stages.keep(large.join(firsts, ["h", "lo", "hi", "before", "bytes"]).filter(at > F.col("first")).select("id", "u", "start", (F.col("start") + F.octet_length("bytes")).alias("stop")), "equal"))
        split = firsts.filter("lo < hi").select("h", "lo", "hi", "before", "bytes", "first.*")
        contexts = stages.keep(arrow_map(split, "h long, id long, u long, start long, before int, bytes binary, lo int, hi int", _halves(length)), "halves")
    spans = out[0]
    for more in out[1:]:
        spans = spans.unionByName(more)
    return spans


def cut_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, stop), kept (bytes) for every row of ``docs`` (doc_id, text)."""
    stages = Stages(spark, "suffix")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("u"), text.alias("text"))
    spans = stages.keep(removed_ranges(stages, rows.select("id", "u", "text"), length), "ranges")
    spans = spans.groupBy("id", "u").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    out = rows.join(spans, ["id", "u"], "left")
    return arrow_map(out.select("doc_id", "text", "spans"), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary", _cut)


def digest(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
