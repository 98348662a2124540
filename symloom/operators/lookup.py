"""The path-lookup cascade over batches of queries.

Every query meets every stage's posting list in equi-joins; the first stage that answers is then picked
per query, and the candidates are classified. After the one exchange on the query all windows share
its partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom import schemas
from symloom.functions import text as T
from symloom.operators.store import materialize

COLUMNS = ("package", "item_id", "path", "name", "kind", "segs", "depth", "path_lc", "name_lc", "reexport_source", "is_stub")


def prepare(queries: DataFrame) -> DataFrame:
    """query_id, package, text, kf -> with lower-case text, segments and whether case matters."""
    return queries.withColumn("q_lc", F.lower("text")).withColumn("q_segs", F.split("text", "::")).withColumn("q_n", F.size("q_segs")).withColumn("cased", F.col("text").rlike(T.UPPER))


def stage(queries: DataFrame, items: DataFrame, number: int) -> DataFrame:
    """Candidates of one stage: 1 exact path, 2 path in any case, 3 suffix, 4 name of a single segment."""
    rows = items.select(*COLUMNS)
    if number == 3:  # a suffix ends in the same segment, so the segment is the key and the rest a comparison
        asked = queries.withColumn("last_lc", F.lower(F.element_at("q_segs", -1)))
        tail = F.endswith(F.concat(F.lit("::"), "path_lc"), F.concat(F.lit("::"), "q_lc"))
        hits = asked.join(rows.withColumn("last_lc", F.lower(F.element_at("segs", -1))), ["package", "last_lc"]).filter(tail).drop("last_lc")
    else:
        key, value = {1: ("text", "path"), 2: ("q_lc", "path_lc"), 4: ("q_lc", "name_lc")}[number]
        asked = queries.filter("q_n = 1") if number == 4 else queries
        hits = asked.join(rows.withColumn(key, F.col(value)), ["package", key])
    return hits.filter("text <> ''").withColumn("stage", F.lit(number))


def admitted():
    """Kind filter, and exact case beyond stage 1 where the query has an upper-case letter."""
    kind = F.col("kf").isNull() | (schemas.filter_group(F.col("kind")) == F.col("kf"))
    tail = F.slice("segs", -F.least("q_n", "depth"), F.col("q_n")) == F.col("q_segs")
    return kind & ((F.col("stage") == 1) | ~F.col("cased") | F.when(F.col("q_n") == 1, F.col("name") == F.col("text")).otherwise(tail))


def repeated_segment():
    """A single-segment query that also names an earlier segment of the path."""
    return (F.col("q_n") == 1) & F.exists(F.slice("segs", F.lit(1), F.col("depth") - 1), lambda s: F.lower(s) == F.col("q_lc"))


def candidates(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Survivors of the chosen stage of each query, with ``pos`` in item order. A stage-1 hit is final even if the kind filter empties it."""
    queries = prepare(queries)
    found = None
    for number in (1, 2, 3, 4):
        part = stage(queries, items, number)
        found = part if found is None else found.unionByName(part)
    per = Window.partitionBy("query_id")
    found = found.withColumn("ok", admitted())
    found = found.withColumn("chosen", F.when(F.max(F.col("stage") == 1).over(per), 1).otherwise(F.min(F.when(F.col("ok"), F.col("stage"))).over(per)))
    found = found.filter(F.col("ok") & (F.col("stage") == F.col("chosen"))).withColumn("dup", (F.col("stage") == 3) & repeated_segment())
    return found.withColumn("fewest", F.min("dup").over(per)).filter("dup = fewest").drop("ok", "chosen", "fewest", "dup").withColumn("pos", F.col("item_id"))


def resolve_stubs(found: DataFrame, items: DataFrame) -> DataFrame:
    """A stub goes if a candidate of its name is no stub; else the first non-stub of that name takes its place."""
    real = F.max(~F.col("is_stub")).over(Window.partitionBy("query_id", "name"))
    found = found.withColumn("real", real).filter("NOT is_stub OR NOT real").drop("real")
    names = items.filter("NOT is_stub").groupBy("package", "name").agg(F.min("item_id").alias("c_id"))
    canon = items.select(*[F.col(c).alias(f"c_{c}") for c in COLUMNS]).join(names.withColumnRenamed("package", "c_package").withColumnRenamed("c_id", "c_item_id").withColumnRenamed("name", "c_name"), ["c_package", "c_name", "c_item_id"], "left_semi")
    found = found.join(canon, F.col("is_stub") & (F.col("package") == F.col("c_package")) & (F.col("name") == F.col("c_name")), "left")
    swap = F.col("c_item_id").isNotNull()
    own = [F.when(swap, F.col(f"c_{c}")).otherwise(F.col(c)).alias(c) for c in COLUMNS if c != "package"]
    return found.select("query_id", "package", "pos", *own)


def distinct_identity(found: DataFrame) -> DataFrame:
    """Of candidates that re-export one symbol of a kind, or are it, the shallowest."""
    per = Window.partitionBy("query_id")
    source = F.lower("reexport_source")
    found = found.withColumn("n", F.count("*").over(per)).withColumn("sources", F.collect_set(source).over(per))
    ident = F.coalesce(source, F.when(F.array_contains("sources", F.col("path_lc")), F.col("path_lc")))
    found = found.withColumn("ident", ident)
    best = F.row_number().over(Window.partitionBy("query_id", "ident", "kind").orderBy("depth", "pos", "item_id"))
    return found.withColumn("best", best).filter("n <= 1 OR ident IS NULL OR best = 1").drop("n", "sources", "ident", "best")


def distinct_path_kind(found: DataFrame) -> DataFrame:
    twin = F.row_number().over(Window.partitionBy("query_id", "path", "kind").orderBy("pos", "item_id"))
    return found.withColumn("twin", twin).filter("twin = 1").drop("twin")


def rank(found: DataFrame) -> DataFrame:
    """Adds status and rank: one candidate, or the only primary symbol at the root, is Found; else Ambiguous in priority order."""
    per = Window.partitionBy("query_id")
    primary = schemas.is_primary(F.col("kind"))
    top, third = (F.col("depth") == 2) & primary, (F.col("depth") == 3) & primary
    count = lambda c: F.sum(c.cast("int")).over(per)
    auto = (count(top) == 1) & (count((F.col("depth") == 2) & ~primary) == 0) & (count(third) == 0)
    n = F.count("*").over(per)
    bucket = F.when(top, 0).when(F.col("depth") == 2, 1).otherwise(2)
    order = Window.partitionBy("query_id").orderBy("bucket", F.when(F.col("bucket") == 2, F.col("depth")).otherwise(0), "path", "pos", "item_id")
    found = found.withColumn("bucket", bucket).withColumn("top", top).withColumn("auto", auto).withColumn("n", n)
    found = found.filter("n = 1 OR NOT auto OR top")
    return found.withColumn("status", F.when((F.col("n") == 1) | F.col("auto"), "Found").otherwise("Ambiguous")).withColumn("rank", F.row_number().over(order)).drop("bucket", "top", "auto", "n")


def classify(found: DataFrame, items: DataFrame) -> DataFrame:
    return rank(distinct_path_kind(distinct_identity(resolve_stubs(found, items))))


def lookup(queries: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, status, rank, item_id, path, kind; a query without an answer has one NotFound row."""
    hits = classify(candidates(queries, items), items).select("query_id", "status", "rank", "item_id", "path", "kind")
    out = queries.select("query_id").join(hits, "query_id", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("NotFound")))


def lookup_method(queries: DataFrame, items: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, package, parent, method, kf -> like ``lookup``; the parent is resolved without the kind filter, and bubbles up if it is not Found."""
    parents = lookup(queries.select("query_id", "package", F.col("parent").alias("text"), F.lit(None).cast("string").alias("kf")), items)
    parents = materialize(parents, "parents")
    one = parents.filter("status = 'Found'").select("query_id", F.col("item_id").alias("parent_id"))
    asked = prepare(queries.withColumn("text", F.col("method"))).join(one, "query_id")
    hits = asked.join(edges, ["package", "parent_id"]).withColumn("item_id", F.col("child_id")).join(items.select(*COLUMNS), ["package", "item_id"])
    hits = hits.filter("name_lc = q_lc").withColumn("stage", F.lit(4)).filter(admitted()).withColumn("pos", F.col("item_id"))
    hits = classify(hits, items).select("query_id", "status", "rank", "item_id", "path", "kind")
    out = one.select("query_id").join(hits, "query_id", "left").withColumn("status", F.coalesce("status", F.lit("NotFound")))
    return out.unionByName(parents.filter("status <> 'Found'"))


def resolve(queries: DataFrame, items: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, package, segments (below the package), kf -> like ``lookup``, with the try that answered.

    Tries in turn: the path under the package, the bare path, both without the kind filter, the last
    segment as a method of the rest under the package, and of the bare rest. No segments: the root."""
    bare = F.array_join("segments", "::")
    root = F.substring_index("package", "@", 1)  # a package held by version has its plain name in paths
    full = F.when(bare == "", root).otherwise(F.concat_ws("::", root, bare))
    none = F.lit(None).cast("string")
    head = F.array_join(F.slice("segments", F.lit(1), F.greatest(F.size("segments") - 1, F.lit(0))), "::")
    method = F.size("segments") > 1
    tries = F.array(
        F.struct(F.lit(1).alias("try"), full.alias("text"), F.when(F.size("segments") > 0, F.col("kf")).alias("kf"), none.alias("method")),
        F.when(F.size("segments") > 0, F.struct(F.lit(2).alias("try"), bare.alias("text"), F.col("kf").alias("kf"), none.alias("method"))),
        F.when((F.size("segments") > 0) & F.col("kf").isNotNull(), F.struct(F.lit(3).alias("try"), full.alias("text"), none.alias("kf"), none.alias("method"))),
        F.when((F.size("segments") > 0) & F.col("kf").isNotNull(), F.struct(F.lit(4).alias("try"), bare.alias("text"), none.alias("kf"), none.alias("method"))),
        F.when(method, F.struct(F.lit(5).alias("try"), F.concat_ws("::", root, head).alias("text"), F.col("kf").alias("kf"), F.element_at("segments", -1).alias("method"))),
        F.when(method, F.struct(F.lit(6).alias("try"), head.alias("text"), F.col("kf").alias("kf"), F.element_at("segments", -1).alias("method"))),
    )
    tries = queries.select(F.col("query_id").alias("origin"), "package", F.explode(F.filter(tries, lambda t: t.isNotNull())).alias("t"))
    tries = tries.select("origin", "package", F.col("t.try").alias("try"), F.col("t.text").alias("text"), F.col("t.kf").alias("kf"), F.col("t.method").alias("method")).withColumn("query_id", F.concat_ws("/", F.col("origin").cast("string"), F.col("try").cast("string")))
    plain = lookup(tries.filter("method IS NULL").select("query_id", "package", "text", "kf"), items)
    called = lookup_method(tries.filter("method IS NOT NULL").select("query_id", "package", F.col("text").alias("parent"), "method", "kf"), items, edges)
    hits = materialize(plain.unionByName(called).filter("status <> 'NotFound'"), "tries")
    hits = tries.select("origin", "try", "query_id").join(hits, "query_id")
    hits = hits.withColumn("first", F.min("try").over(Window.partitionBy("origin"))).filter("try = first")
    out = queries.select("query_id").join(hits.drop("query_id", "first").withColumnRenamed("origin", "query_id"), "query_id", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("NotFound")))
