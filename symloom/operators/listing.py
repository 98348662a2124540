"""Hierarchy listings: children, recursive trees, groups, trait implementations, source slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom import schemas


def visible(include_private: bool = False) -> Column:
    return F.lit(True) if include_private else F.col("is_public")


def of_kind(kind: str | None) -> Column:
    return F.lit(True) if kind is None else schemas.filter_group(F.col("kind")) == kind


def children_of(items: DataFrame, edges: DataFrame, parents: DataFrame, kind: str | None = None, include_private: bool = False) -> DataFrame:
    """parent_id, pos and item columns of the visible children of ``parents`` (package, item_id)."""
    own = edges.join(parents.select("package", F.col("item_id").alias("parent_id")), ["package", "parent_id"], "left_semi")
    rows = own.join(items.withColumnRenamed("item_id", "child_id"), ["package", "child_id"])
    return rows.filter(visible(include_private) & of_kind(kind)).withColumnRenamed("child_id", "item_id")


def tree(items: DataFrame, edges: DataFrame, root_path: str, kind: str | None = None, include_private: bool = False) -> DataFrame:
    """package, item_id, path, kind, level of everything below the modules under ``root_path``.

    Only modules recurse, one for each path (twins are never expanded); the other kinds join once."""
    spark = items.sparkSession
    modules = items.filter((F.col("kind") == "Module") & (visible(include_private) | (F.col("path") == root_path))).groupBy("package", "path").agg(F.min("item_id").alias("item_id"))
    steps = edges.join(modules.select("package", F.col("item_id").alias("child_id")), ["package", "child_id"], "left_semi").select("package", "parent_id", "child_id")
    reached = spark.sql(
        """WITH RECURSIVE walk(package, item_id, level, seen) AS (
             SELECT package, item_id, 0, array(item_id) FROM {modules} WHERE path = {root}
             UNION ALL
             SELECT w.package, s.child_id, w.level + 1, array_append(w.seen, s.child_id) FROM walk w
             JOIN {steps} s ON s.package = w.package AND s.parent_id = w.item_id WHERE NOT array_contains(w.seen, s.child_id))
           SELECT package, item_id, min(level) AS level FROM walk GROUP BY package, item_id""",
        modules=modules, steps=steps, root=root_path,
    )
    below = edges.join(reached.withColumnRenamed("item_id", "parent_id"), ["package", "parent_id"]).withColumnRenamed("child_id", "item_id")
    rows = below.join(items.select("package", "item_id", "path", "kind", "is_public"), ["package", "item_id"]).filter(visible(include_private))
    twin = F.row_number().over(Window.partitionBy("package", "path", "kind").orderBy("level", "item_id"))
    rows = rows.withColumn("twin", twin).filter("twin = 1").filter(of_kind(kind))
    return rows.select("package", "item_id", "path", "kind", (F.col("level") + 1).alias("level"))


def by_category(items: DataFrame, edges: DataFrame, parents: DataFrame, include_private: bool = False) -> DataFrame:
    """parent_id, header, rank (by name within the header), item_id, name of the children."""
    rows = children_of(items, edges, parents, None, include_private).withColumn("cat", schemas.category(F.col("kind")))
    order = F.row_number().over(Window.partitionBy("package", "parent_id", "cat").orderBy("name", "pos"))
    return rows.select("package", "parent_id", "cat", schemas.header(F.col("cat")).alias("header"), order.alias("rank"), "item_id", "name")


def by_module(items: DataFrame) -> DataFrame:
    """module_path and its symbols' counts; a symbol without parent counts for its package's root."""
    module = F.when(F.col("module_path") == "", F.col("package")).otherwise(F.col("module_path"))
    return items.groupBy("package", module.alias("module_path")).agg(F.count("*").alias("n_items"), F.max(F.octet_length("path")).alias("widest"))


def type_children(items: DataFrame, edges: DataFrame) -> DataFrame:
    """parent_id, part (methods or variants), rank, name of every type, whatever their visibility."""
    types = items.filter(F.col("kind").isin("Struct", "Enum", "Union", "Trait", "TraitAlias", "TypeAlias"))
    rows = children_of(items, edges, types, None, True).filter(F.col("kind").isin("Function", "Variant"))
    part = F.when(F.col("kind") == "Function", "methods").otherwise("variants")
    rows = rows.withColumn("part", part)
    return rows.select("package", "parent_id", "part", F.row_number().over(Window.partitionBy("package", "parent_id", "part").orderBy("name", "pos")).alias("rank"), "item_id", "name")


def methods_split(items: DataFrame, edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Functions of each parent, required (without body) before provided."""
    rows = children_of(items, edges, parents, "Function", True)
    order = Window.partitionBy("package", "parent_id", "has_body").orderBy("pos")
    return rows.select("package", "parent_id", F.when(F.col("has_body"), "provided").otherwise("required").alias("part"), F.row_number().over(order).alias("rank"), "item_id", "name")


def impls(trait_impls: DataFrame, keys: list[str], trait: str | None = None) -> DataFrame:
    """Trait implementations, automatic ones last; ``trait`` filters by a part of the path in any case."""
    rows = trait_impls if trait is None else trait_impls.filter(F.contains(F.lower("trait_path"), F.lit(trait.lower())))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("is_synthetic", "trait_path")))


def implementors(trait_impls: DataFrame, trait: str) -> DataFrame:
    """Extension: the types that implement a trait."""
    return trait_impls.filter(F.col("trait_path") == trait)


def source_slice(files: DataFrame, spans: DataFrame) -> DataFrame:
    """file, line_start, line_end and the lines between, from whole files (file, text); unknown lines give none."""
    lines = F.split("text", "\n")
    first = F.least(F.col("line_start"), F.size(lines) + 1)
    part = F.slice(lines, first, F.greatest(F.least(F.col("line_end"), F.size(lines)) - first + 1, F.lit(0)))
    rows = spans.filter("line_start > 0").join(files, "file")
    return rows.select(*spans.columns, F.array_join(part, "\n").alias("source"))


def readme(files: DataFrame, names: list[str]) -> DataFrame:
    """package, text of the first of ``names`` that a package holds (package, file, text)."""
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("file"))
    return files.filter(F.col("file").isin(names)).groupBy("package").agg(F.min_by("text", order).alias("text"))
