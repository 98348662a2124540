"""Ranked search: alternatives of AND terms, scored in tiers, cut before paths are made distinct."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom import schemas
from symloom.functions import text as T

LIMIT = 20
# Points of a term found as the name, in the name, the signature, the parent path, the docs.
TIERS = {"name": 100, "in_name": 75, "signature": 40, "module": 30, "docs": 20}


def parse(query: str) -> list[list[str]]:
    groups = [[t for t in re.split(r"\s+", g) if t] for g in query.lower().split("|")]
    groups = [g for g in groups if g]
    if not groups:
        raise ValueError("empty search query")
    return groups


def term_score(term: Column) -> Column:
    has = lambda c: F.contains(F.col(c), term)
    tiers = {"name": F.col("name_lc") == term, "in_name": has("name_lc"), "signature": has("sig_lc"), "module": F.contains(F.lower("module_path"), term), "docs": has("docs_lc")}
    ladder = None
    for tier, hit in tiers.items():
        ladder = F.when(hit, TIERS[tier]) if ladder is None else ladder.when(hit, TIERS[tier])
    return ladder.otherwise(0)


def score(query: str) -> Column:
    """The best alternative; an alternative sums its terms and fails with any of them."""
    groups = []
    for terms in parse(query):
        points = [term_score(F.lit(t)) for t in terms]
        every = reduce(lambda a, b: a & b, [p > 0 for p in points])
        groups.append(F.when(every, reduce(lambda a, b: a + b, points)).otherwise(0))
    return (F.greatest(*groups) if len(groups) > 1 else groups[0]).cast("int")


_ASKED = "array<struct<id:bigint,groups:array<array<string>>>>"


def search_batch(items: DataFrame, queries: dict[int, str], kind: str | None = None, limit: int = LIMIT) -> DataFrame:
    """query_id, rank, item_id, path, kind, signature, score. The queries are one literal that every row is held
    against, so the plan stays as small for ten thousand as for ten; a task keeps ``limit`` rows a query before anything moves."""
    if kind:
        items = items.filter(schemas.filter_group(F.col("kind")) == kind)
    asked = F.from_json(F.lit(json.dumps([{"id": i, "groups": parse(q)} for i, q in queries.items()])), _ASKED)

    def group_score(terms: Column) -> Column:
        points = F.transform(terms, term_score)
        return F.when(F.exists(points, lambda p: p == 0), 0).otherwise(F.aggregate(points, F.lit(0), lambda a, p: a + p))

    hits = F.filter(F.transform(asked, lambda q: F.struct(q["id"].alias("query_id"), F.array_max(F.transform(q["groups"], group_score)).alias("score"))), lambda x: x["score"] > 0)
    rows = items.select("package", "item_id", "path", "kind", "signature", F.explode(hits).alias("h")).select("*", "h.query_id", "h.score").drop("h")
    best = Window.partitionBy("package", "query_id").orderBy(F.desc("score"), "path", "item_id")
    top = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    twin = F.row_number().over(Window.partitionBy("package", "query_id", "path").orderBy("rank"))
    return top.withColumn("twin", twin).filter("twin = 1").select("package", "query_id", "rank", "item_id", "path", "kind", "signature", "score")


def search(items: DataFrame, query: str, kind: str | None = None, limit: int = LIMIT) -> DataFrame:
    """rank, item_id, path, kind, signature, score of the ``limit`` best rows, best first, one for each path."""
    if kind:
        items = items.filter(schemas.filter_group(F.col("kind")) == kind)
    order = Window.orderBy(F.desc("score"), "path", "item_id")  # the rows that the limit left, in one partition already
    top = items.withColumn("score", score(query)).filter("score > 0").orderBy(F.desc("score"), "path", "item_id").limit(limit)
    before = F.collect_list("path").over(order.rowsBetween(Window.unboundedPreceding, -1))
    top = top.withColumn("rank", F.row_number().over(order)).withColumn("before", before)
    return top.filter(~F.array_contains("before", F.col("path"))).select("rank", "item_id", "path", "kind", "signature", "score", *[c for c in ("summary",) if c in items.columns])


def as_json(hits: DataFrame) -> DataFrame:
    """rank, line: a JSON object for each hit (with its summary), keys in alphabetical order."""
    return hits.select("rank", F.to_json(F.struct(schemas.short_name(F.col("kind")).alias("kind"), "path", "score", "signature", F.coalesce("summary", F.lit("")).alias("summary"))).alias("line"))


def as_text(hits: DataFrame, query: str) -> DataFrame:
    """text: the number of hits and a line for each, kinds and paths as wide as the widest."""
    rows = hits.select("rank", schemas.short_name(F.col("kind")).alias("short"), "path", F.coalesce("summary", F.lit("")).alias("summary"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("rank", "short", "path", "summary"))).alias("x"), F.max(F.octet_length("short")).alias("wk"), F.max(F.octet_length("path")).alias("wp"))  # at most ``LIMIT`` rows
    line = lambda x: F.concat(T.pad(x["short"], F.col("wk")), F.lit("  "), T.pad(x["path"], F.col("wp")), F.when(x["summary"] == "", "").otherwise(F.concat(F.lit("  "), x["summary"])))
    head = F.concat(F.size("x").cast("string"), F.lit(f' results for "{query}":'))
    return one.select(F.when(F.size("x") == 0, head).otherwise(F.concat(head, F.lit("\n\n"), F.array_join(F.transform("x", line), "\n"))).alias("text"))


def hint(items: DataFrame, wider: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """n_wider: how many hits a query without any in ``items`` has in the index built with all features; else no row."""
    none = search(items, query, kind, 1).agg(F.count("*").alias("n")).filter("n = 0")
    return none.join(search(wider, query, kind).agg(F.count("*").alias("n_wider")), F.lit(True)).filter("n_wider > 0").select("n_wider")  # a row on each side
