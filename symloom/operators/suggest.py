"""Did-you-mean: names and paths within a few edits of a query that found nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import text as T

MOST, SHOWN = 3, 5


def _near(query, path, name):
    last = F.substring_index(query, "::", -1)
    d = F.least(T.distance(query, path, MOST), T.distance(query, name, MOST), T.distance(last, name, MOST))
    some = T.may_be_near(query, path, MOST) | T.may_be_near(query, name, MOST) | T.may_be_near(last, name, MOST)
    return F.when(some, d)


def _top(rows: DataFrame) -> DataFrame:
    """The ``SHOWN`` nearest distinct texts of each query; tasks keep that many each before rows move."""
    near = rows.groupBy("query_id", "path").agg(F.min("distance").alias("distance"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "path"))
    return near.withColumn("rank", best).filter(F.col("rank") <= SHOWN).select("query_id", "rank", "distance", "path")


def suggestions(queries: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, rank, distance, path. The unmatched queries (query_id, package, text) are a stated set, sent whole
    to every task where its size allows; distances run once for each distinct path and name."""
    names = items.select("package", "path", "name").distinct()
    q = F.lower(F.col("text"))
    met = queries.join(names, "package").withColumn("distance", _near(q, F.lower("path"), F.lower("name"))).filter(F.col("distance") <= MOST)
    return _top(met.select("query_id", "distance", "path"))


def block(found: DataFrame) -> DataFrame:
    """query_id, text: what a message appends for the suggestions of a query (query_id, rank, path)."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: F.concat(F.lit("\n  "), x["path"])), "")
    return found.groupBy("query_id").agg(F.concat(F.lit("\n\nDid you mean:"), lines).alias("text"))


def not_found(queries: DataFrame, hits: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, suggestions, message, exit_code of the queries (query_id, package, text) that a lookup did not find."""
    lost = queries.join(hits.filter("status = 'NotFound'").select("query_id"), "query_id", "left_semi")
    found = suggestions(lost, items)
    near = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("suggestions"))
    out = lost.join(near, "query_id", "left").join(block(found).withColumnRenamed("text", "more"), "query_id", "left")
    message = F.concat(F.lit('no item matching "'), "text", F.lit('" in crate \''), "package", F.lit("'"), F.coalesce("more", F.lit("")))
    return out.select("query_id", F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"), message.alias("message"), F.lit(1).alias("exit_code"))


def child_suggestions(queries: DataFrame, items: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, rank, distance, path over the children of a parent (query_id, package, parent_id, method)."""
    kids = queries.join(edges, ["package", "parent_id"]).join(items.select("package", F.col("item_id").alias("child_id"), "name", "path"), ["package", "child_id"])
    method, name = F.lower("method"), F.lower("name")
    d = F.when(T.may_be_near(method, name, MOST), T.distance(method, name, MOST))
    return _top(kids.withColumn("distance", d).filter(F.col("distance") <= MOST).select("query_id", "distance", "path"))
