"""Derived columns and edge tables of a symbol index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import text as T

DOC_BYTES = 500


def derive(items: DataFrame) -> DataFrame:
    """What lookups and searches filter on: lower-case forms, segments, depth, parent path, the searched head of the docs."""
    segs = F.split("path", "::")
    return (
        items.withColumn("segs", segs)
        .withColumn("depth", F.size("segs"))
        .withColumn("path_lc", F.lower("path"))
        .withColumn("name_lc", F.lower("name"))
        .withColumn("sig_lc", F.lower("signature"))
        .withColumn("docs_lc", F.lower(T.utf8_prefix(F.col("docs"), DOC_BYTES)))
        .withColumn("module_path", F.when(F.col("depth") > 1, F.array_join(F.slice("segs", F.lit(1), F.col("depth") - 1), "::")).otherwise(""))
    )


def suffix_table(items: DataFrame) -> DataFrame:
    """package, suffix_lc, item_id: one row for every trailing run of segments."""
    return items.select("package", F.explode(T.suffixes(F.col("path"))).alias("suffix_lc"), "item_id")


def children(items: DataFrame) -> DataFrame:
    """package, parent_id, pos, child_id by parent path; of several parents with one path the first holds the children."""
    parents = items.filter(F.col("kind").isin("Module", "Struct", "Enum", "Union", "Trait")).groupBy("package", F.col("path").alias("module_path")).agg(F.min("item_id").alias("parent_id"))
    edges = items.filter("depth > 1").select("package", "module_path", "item_id").join(parents, ["package", "module_path"])
    pos = F.row_number().over(Window.partitionBy("package", "parent_id").orderBy("item_id")) - 1
    return edges.select("package", "parent_id", pos.alias("pos"), F.col("item_id").alias("child_id"))


def with_stubs(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds n_children and is_stub (a re-export line without children)."""
    count = edges.groupBy("package", F.col("parent_id").alias("item_id")).agg(F.count("*").cast("int").alias("n_children"))
    out = items.join(count, ["package", "item_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return out.withColumn("is_stub", F.startswith("signature", F.lit("pub use ")) & (F.col("n_children") == 0))
