"""Line dedup with a log-template tree.

Every line falls through a tree of fixed depth: first its number of tokens, then its ``LEAD`` leading
tokens, in which a variable token (one that holds a digit) becomes ``<*>``. Below a leaf a line yields
its templates: the line with variable tokens generalised, and, if it has at least ``BLOCKS`` tokens after
the lead, ``BLOCKS`` further ones, each with another block of consecutive tokens generalised as a
variable field. Lines share a template when they agree on everything else. Templates travel as 64-bit
hashes, so no leaf is ever gathered in one place, and counts are pre-aggregated.

A template recurs when at least ``min_docs`` documents hold it and these are not all exact copies of one
text (such copies are left to near-dedup). A line with a recurring template is dropped wherever the
document is not the first (smallest id) to hold that template, so one example of each stays.

Defined results: blank lines never match and stay; a null text stays null; repeated rows are the same
document; a null id counts as the largest; an empty table gives an empty result; other columns pass
through ``drop_lines`` unchanged, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, arrow_map, texts

LEAD = 2
BLOCKS = 4
MIN_DOCS = 3
NULL_ID = 2**63 - 1
_VARIABLE = re.compile(rb"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_FIELD = b"<*>"


def templates(line: bytes) -> list[bytes]:
    """Keys of the leaf and the templates of a line, as bytes; none for a blank line."""
    tokens = (_VARIABLE.sub(_FIELD, line) if re.search(rb"[0-9]", line) else line).split()
    n = len(tokens)
    if not n:
        return []
    head = b"%d " % n + b" ".join(tokens[:LEAD]) + b"|"
    rest = tokens[LEAD:]
    out = [head + b" ".join(rest)]
    if len(rest) >= BLOCKS:
        for i in range(BLOCKS):
            a, b = len(rest) * i // BLOCKS, len(rest) * (i + 1) // BLOCKS
            out.append(head + b"%d:%d|" % (a, b) + b" ".join(rest[:a] + [_FIELD] + rest[b:]))
    return out


def line_keys(text: bytes) -> list[list[int]]:
    """Signed 64-bit hashes of the templates of every line."""
    return [[xxhash.xxh3_64_intdigest(t) - 2**63 for t in templates(line)] for line in text.split(b"\n")]


def _occurrences(cols):
    """A row for each template and line; ``head`` is 1 where a text holds the template for the first time."""
    ids, uids, lines, keys, heads = [], [], [], [], []
    for doc_id, uid, text in zip(cols["id"].to_pylist(), cols["uid"].to_pylist(), texts(cols["text"]), strict=True):
        met: set[int] = set()
        for no, own in enumerate(line_keys(text)):
            keys += own
            heads += [k not in met for k in own]
            met.update(own)
            lines += [no] * len(own)
        n = len(keys) - len(ids)
        ids += [doc_id] * n
        uids += [uid] * n
    return {"key": np.array(keys, dtype=np.int64), "uid": np.array(uids, dtype=np.int64), "id": np.array(ids, dtype=np.int64), "line": np.array(lines, dtype=np.int32), "head": np.array(heads, dtype=np.int32)} if ids else None


def dropped(stages: Stages, rows: DataFrame, min_docs: int) -> DataFrame:
    """id, uid, lines (numbers of the lines to drop, ascending) of rows (id, uid: hash of the text, text)."""
    seen = stages.keep(arrow_map(rows, "key long, uid long, id long, line int, head int", _occurrences), "lines")
    many = stages.keep(rows.groupBy("id", "uid").agg(F.count("*").alias("times")).filter("times > 1"), "repeated")
    heads, weight = seen, F.col("head").cast("double")
    if not many.isEmpty():  # each of a document's repeated rows counts for its share of it
        heads, weight = seen.join(many, ["id", "uid"], "left"), F.col("head") / F.coalesce("times", F.lit(1))
    held = heads.groupBy("key").agg(F.sum(weight).alias("n"), F.min("id").alias("first"), F.min("uid").alias("lo"), F.max("uid").alias("hi"))
    recurring = held.filter((F.col("n") > min_docs - 0.5) & (F.col("lo") < F.col("hi"))).select("key", "first")
    hits = seen.select("key", "id", "uid", "line").join(recurring, "key").filter("id <> first")
    return hits.groupBy("id", "uid").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _rewrite(keep: list[str]):
    def work(cols):
        out, cut, total = [], [], []
        for text, valid, lines in zip(texts(cols["text"]), cols["text"].is_valid().to_pylist(), cols["_lines"].to_pylist(), strict=True):
            parts = text.split(b"\n")
            gone = set(lines or ())
            kept = [p for i, p in enumerate(parts) if i not in gone] if gone else parts
            out.append(b"\n".join(kept).decode() if valid else None)
            cut.append(len(gone))
            total.append(len(parts) if valid else 0)
        return {c: cols[c] for c in keep} | {"text": out, "_dropped": cut, "_total": total}

    return work


def drop_lines(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with recurring lines cut from ``text``, plus ``_dropped`` and ``_total`` (numbers of lines)."""
    stages = Stages(spark, "lines")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: f"c{i}" for i, n in enumerate(names)}
    rows = plain.select(F.coalesce(F.col(at["doc_id"]).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.col(at["text"]).cast("string")).alias("uid"), F.col(at["text"]).cast("string").alias("text"))
    gone = dropped(stages, rows, min_docs).select(F.col("id").alias("_id"), F.col("uid").alias("_uid"), F.col("lines").alias("_lines"))
    keep = [c for n, c in at.items() if n != "text"]
    plain = plain.withColumn(at["text"], F.col(at["text"]).cast("string"))
    same = (F.coalesce(F.col(at["doc_id"]).cast("long"), F.lit(NULL_ID)) == F.col("_id")) & (F.xxhash64(at["text"]) == F.col("_uid"))
    both = plain.join(gone, same, "left").select(*keep, F.col(at["text"]).alias("text"), "_lines")
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + ["text string", "_dropped long", "_total long"])
    back = {c: n for n, c in at.items()}
    out = arrow_map(both, schema, _rewrite(keep))
    return out.select(*[F.col(at[n] if n != "text" else "text").alias(n) for n in names], "_dropped", "_total")
