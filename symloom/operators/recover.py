"""Following re-exports when a lookup found nothing, or only stubs: into the same package by name, or one hop into another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom import schemas
from symloom.functions import text as T
from symloom.operators import lookup as L
from symloom.operators.store import materialize


def same_name(queries: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, package, text, kf -> candidates whose name is the last segment, re-exported ones first choice."""
    last = F.substring_index("text", "::", -1)
    asked = queries.withColumn("last", last).withColumn("last_lc", F.lower(last))
    rows = items.select("package", "item_id", "path", "name", "kind", F.col("name_lc").alias("last_lc"), "reexport_source")
    hits = asked.join(rows, ["package", "last_lc"])
    cased = F.col("last").rlike(T.UPPER)
    hits = hits.filter((~cased | (F.col("name") == F.col("last"))) & (F.col("kf").isNull() | (schemas.filter_group(F.col("kind")) == F.col("kf"))))
    per = Window.partitionBy("query_id")
    hits = hits.withColumn("sourced", F.col("reexport_source").isNotNull()).withColumn("any", F.max("sourced").over(per)).filter("sourced = any")
    n = F.count("*").over(per)
    return hits.select("query_id", F.when(n == 1, "Found").otherwise("Ambiguous").alias("status"), F.row_number().over(per.orderBy("item_id")).alias("rank"), "item_id", "path", "kind")


def by_name(queries: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, package, name -> the first row of that exact name, real symbols before stubs."""
    first = items.groupBy("package", "name").agg(F.min(F.struct("is_stub", "item_id", "path", "kind")).alias("f"))
    return queries.join(first, ["package", "name"]).select("query_id", "package", F.col("f.item_id").alias("item_id"), F.col("f.path").alias("path"), F.col("f.kind").alias("kind"))


def _into(asked: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, try, source, priority -> the best answer in the source's package, its path first, then its last name."""
    asked = asked.withColumn("package", F.substring_index("source", "::", 1)).withColumn("key", F.concat_ws("|", F.col("query_id").cast("string"), "priority"))
    exact = L.lookup(asked.select(F.col("key").alias("query_id"), "package", F.col("source").alias("text"), F.lit(None).cast("string").alias("kf")), items).filter("status = 'Found'")
    named = by_name(asked.select(F.col("key").alias("query_id"), "package", F.substring_index("source", "::", -1).alias("name")), items)
    found = exact.select("query_id", "item_id", "path", "kind", F.lit(0).alias("way")).unionByName(named.select("query_id", "item_id", "path", "kind", F.lit(1).alias("way")))
    found = asked.select("query_id", "package", "priority", "key").join(found.withColumnRenamed("query_id", "key"), "key")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("priority", "way", "item_id"))
    return found.withColumn("best", best).filter("best = 1").select("query_id", "package", "item_id", "path", "kind")


def follow(stubs: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, reexport_source, signature of stubs -> the row they stand for, one hop away."""
    source = T.reexport_source(F.col("reexport_source"), F.col("signature"))
    return _into(stubs.select("query_id", source.alias("source"), F.lit("0").alias("priority")).filter("source IS NOT NULL"), items)


def by_prefix(queries: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, package, segments -> descent through the longest prefix that is a stub, into its source."""
    n = F.size("segments")
    cut = queries.select("query_id", "package", "segments", F.explode(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).alias("len")).filter(F.col("len") < n)
    head, rest = F.array_join(F.slice("segments", F.lit(1), F.col("len")), "::"), F.array_join(F.slice("segments", F.col("len") + 1, n), "::")
    cut = cut.select("query_id", "package", "len", rest.alias("rest"), F.explode(F.array(F.concat_ws("::", F.substring_index("package", "@", 1), head), head)).alias("path"))
    stubs = items.filter("is_stub").select("package", "path", T.reexport_source(F.col("reexport_source"), F.col("signature")).alias("base")).filter("base IS NOT NULL")
    asked = cut.join(stubs, ["package", "path"]).select("query_id", F.concat_ws("::", "base", "rest").alias("source"), F.lpad((F.lit(10**6) - F.col("len")).cast("string"), 7, "0").alias("priority")).distinct()
    return _into(asked, items)


def by_glob(queries: DataFrame, items: DataFrame, globs: DataFrame) -> DataFrame:
    """query_id, package, segments -> descent through glob re-exports (package, parent_path, source_path), deepest parent first."""
    n = F.size("segments")
    cut = queries.select("query_id", "package", "segments", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("len"))
    head = F.array_join(F.slice("segments", F.lit(1), F.col("len")), "::")
    parent = F.when(F.col("len") == 0, F.lit("")).otherwise(head)
    cut = cut.select("query_id", "package", "len", F.array_join(F.slice("segments", F.col("len") + 1, n), "::").alias("rest"), F.explode(F.array(parent, F.when(F.col("len") == 0, F.substring_index("package", "@", 1)).otherwise(F.concat_ws("::", F.substring_index("package", "@", 1), head)))).alias("parent_path")).distinct()
    asked = cut.join(globs, ["package", "parent_path"]).select("query_id", F.concat_ws("::", "source_path", "rest").alias("source"), F.concat(F.lpad((F.lit(10**6) - F.col("len")).cast("string"), 7, "0"), F.lit(":"), "source_path").alias("priority")).distinct()
    return _into(asked, items)


def recover(queries: DataFrame, items: DataFrame, edges: DataFrame, globs: DataFrame) -> DataFrame:
    """The whole ladder: resolve; by name; through stub prefixes; through globs. Each rung sees only what is left."""
    done = materialize(L.resolve(queries, items, edges), "resolved")
    lost = queries.join(done.filter("status = 'NotFound'").select("query_id"), "query_id", "left_semi")
    named = materialize(same_name(lost.withColumn("text", F.array_join("segments", "::")), items), "named")
    lost = lost.join(named.select("query_id"), "query_id", "left_anti")
    # What is found only as re-exports of several things descends too; where that fails it stays as it was.
    first = materialize(done.filter("status <> 'NotFound'").select("query_id", "status", "rank", "item_id", "path", "kind", F.lit("resolve").alias("rung")).unionByName(named.withColumn("rung", F.lit("name"))), "first")
    sources = items.select("package", "item_id", "reexport_source")
    only = first.filter("status = 'Ambiguous'").join(queries.select("query_id", "package"), "query_id").join(sources, ["package", "item_id"]).groupBy("query_id").agg(F.min(F.col("reexport_source").isNotNull()).alias("every")).filter("every").select("query_id")
    deep = materialize(by_prefix(lost.unionByName(queries.join(only, "query_id", "left_semi")), items), "prefixed")
    first = first.join(deep.select("query_id"), "query_id", "left_anti")
    lost = lost.join(deep.select("query_id"), "query_id", "left_anti")
    wide = by_glob(lost, items, globs)
    parts = [first]
    for rung, rows in (("prefix", deep), ("glob", wide)):
        parts.append(rows.select("query_id", F.lit("Found").alias("status"), F.lit(1).alias("rank"), "item_id", "path", "kind", F.lit(rung).alias("rung")))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return queries.select("query_id").join(hits, "query_id", "left").withColumn("status", F.coalesce("status", F.lit("NotFound")))
