"""From documentation JSON to the symbol index: joins over exploded items, pass by pass.

Where several parents or paths claim an item the choice is fixed: a parent that is no impl before an
impl, then the smaller id; of several hoisted paths the smallest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import signature as sig
from symloom.functions import text as T
from symloom.operators.store import materialize
from symloom.sources import docjson

HOPS = 20
# Item tags and their kinds; other tags are no symbols.
ITEM_KINDS = {"module": "Module", "struct": "Struct", "enum": "Enum", "union": "Union", "trait": "Trait", "trait_alias": "TraitAlias", "function": "Function", "type_alias": "TypeAlias", "assoc_type": "AssocType", "extern_type": "ForeignType", "constant": "Constant", "assoc_const": "AssocConst", "static": "Static", "macro": "Macro", "proc_macro": "ProcMacro", "variant": "Variant", "struct_field": "Field", "primitive": "Primitive"}
# Kinds of the summary table.
SUMMARY_KINDS = ITEM_KINDS | {"proc_attribute": "ProcMacro", "proc_derive": "ProcMacro"}
# Fallback words of a signature.
SHORT = {"Module": "mod", "Struct": "struct", "Enum": "enum", "Union": "union", "Trait": "trait", "TraitAlias": "trait alias", "Function": "fn", "TypeAlias": "type", "AssocType": "type", "ForeignType": "type", "Constant": "const", "AssocConst": "const", "Static": "static", "Macro": "macro", "ProcMacro": "proc macro", "Variant": "variant", "Field": "field", "Primitive": "primitive"}


def _map(pairs: dict[str, str]):
    return lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), c)


def _get(variant: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(variant), path, kind)


def _held(variant: str, path: str) -> Column:
    """Whether a field is there and no JSON null, which the format writes for what is absent."""
    found = _get(variant, path, "variant")
    return found.isNotNull() & ~F.is_variant_null(found)


def nodes(docs: DataFrame) -> DataFrame:
    """package, id, tag and the scalar fields of every item, with its ordered id lists."""
    rows = docjson.items(docs)
    ids = lambda p: F.coalesce(_get("body", p, "array<string>"), F.array().cast("array<string>"))
    fields = F.coalesce(
        F.when(F.col("tag").isin("struct", "variant"), F.coalesce(_get("body", "$.kind.plain.fields", "array<string>"), _get("body", "$.kind.struct.fields", "array<string>"), _get("body", "$.kind.tuple", "array<string>"))),
        F.when(F.col("tag") == "union", _get("body", "$.fields", "array<string>")),
        F.array().cast("array<string>"),
    )
    visibility = F.coalesce(_get("item", "$.visibility", "string"), F.lit("restricted"))
    kind = _map(ITEM_KINDS)(F.col("tag"))
    public = (visibility == "public") | ((visibility == "default") & kind.isin("Variant", "Function", "Field"))
    gate = F.try_element_at(F.filter(F.transform(F.coalesce(_get("item", "$.attrs", "array<string>"), F.array().cast("array<string>")), lambda a: F.regexp_extract(a, r'cfg\(feature[^"]*"([^"]*)"', 1)), lambda g: g != ""), F.lit(1))
    span = F.struct(F.coalesce(_get("item", "$.span.filename", "string"), F.lit("")).alias("file"), F.coalesce(_get("item", "$.span.begin[0]", "int"), F.lit(0)).alias("line_start"), F.coalesce(_get("item", "$.span.end[0]", "int"), F.lit(0)).alias("line_end"))
    return rows.select(
        "package", "id", "tag", kind.alias("kind"), _get("item", "$.name", "string").alias("name"), F.coalesce(_get("item", "$.docs", "string"), F.lit("")).alias("docs"), public.alias("is_public"), (visibility == "public").alias("shown"),
        F.when(F.col("tag").isin("module", "trait", "impl"), ids("$.items")).when(F.col("tag") == "enum", ids("$.variants")).otherwise(fields).alias("members"), F.when(F.col("tag").isin("struct", "enum", "union"), ids("$.impls")).otherwise(F.array().cast("array<string>")).alias("impls"), fields.alias("fields"),
        F.coalesce(_get("body", "$.has_body", "boolean"), F.lit(False)).alias("has_body"), gate.alias("feature_gate"), span.alias("span"),
        _get("body", "$.trait.path", "string").alias("trait_path"), _held("body", "$.blanket_impl").alias("blanket"), F.coalesce(_get("body", "$.is_synthetic", "boolean"), F.lit(False)).alias("synthetic"),
        _get("body", "$.for.resolved_path.id", "string").alias("for_id"), _get("body", "$.for.resolved_path.path", "string").alias("for_path"),
        _get("body", "$.source", "string").alias("use_source"), _get("body", "$.name", "string").alias("use_name"), _get("body", "$.id", "string").alias("use_id"), F.coalesce(_get("body", "$.is_glob", "boolean"), F.lit(False)).alias("is_glob"),
        F.to_json("item").alias("json"),
    )


def parents(rows: DataFrame) -> DataFrame:
    """package, id, parent: the item that lists another as a member, directly or through an impl."""
    own = rows.filter("tag <> 'use'").select("package", F.col("id").alias("parent"), F.explode("members").alias("id"), (F.col("tag") == "impl").alias("via"))
    impls = rows.filter("tag = 'impl'").select("package", F.col("id").alias("impl"), "members")
    types = rows.select("package", F.col("id").alias("parent"), F.explode("impls").alias("impl")).join(impls, ["package", "impl"]).select("package", "parent", F.explode("members").alias("id"), F.lit(False).alias("via"))
    best = own.unionByName(types).groupBy("package", "id").agg(F.min(F.struct("via", F.expr("try_cast(parent AS BIGINT)").alias("n"), "parent")).alias("b"))
    return best.select("package", "id", F.col("b.parent").alias("parent"))


def item_paths(docs: DataFrame, rows: DataFrame, up: DataFrame) -> DataFrame:
    """package, id, path: the summary's, or under a module that re-exports all of another, or under a type or trait, or climbed to."""
    seed = docjson.paths(docs).select("package", "id", "path")
    uses = rows.filter("tag = 'use' AND is_glob AND use_id IS NOT NULL").select("package", F.col("id").alias("use"), F.col("use_id").alias("target"))
    importing = rows.filter("tag = 'module'").select("package", F.col("id").alias("module"), F.explode("members").alias("use"))
    targets = rows.filter("tag = 'module'").select("package", F.col("id").alias("target"), F.explode("members").alias("id"))
    named = rows.select("package", "id", "name", "tag")
    hoisted = uses.join(importing, ["package", "use"]).join(targets, ["package", "target"]).join(named.filter("name IS NOT NULL AND tag <> 'use'"), ["package", "id"]).join(seed.select("package", F.col("id").alias("module"), F.col("path").alias("base")), ["package", "module"])
    hoisted = hoisted.groupBy("package", "id").agg(F.min(F.concat_ws("::", "base", "name")).alias("moved"))
    known = seed.join(hoisted, ["package", "id"], "full_outer").select("package", "id", F.coalesce("moved", "path").alias("path"))
    known = materialize(known, "seeds")
    # Members of impls (under the type), then of traits.
    impls = rows.filter("tag = 'impl'").select("package", F.col("for_id").alias("owner"), "for_path", F.explode("members").alias("id"))
    impls = impls.join(known.select("package", F.col("id").alias("owner"), F.col("path").alias("base")), ["package", "owner"], "left").select("package", "id", F.coalesce("base", "for_path").alias("base"))
    traits = rows.filter("tag = 'trait'").select("package", F.col("id").alias("owner"), F.explode("members").alias("id")).join(known.select("package", F.col("id").alias("owner"), F.col("path").alias("base")), ["package", "owner"]).select("package", "id", "base")
    for owned in (impls, traits):
        new = owned.filter("base IS NOT NULL").join(named.filter("name IS NOT NULL"), ["package", "id"]).groupBy("package", "id").agg(F.min(F.concat_ws("::", "base", "name")).alias("path"))
        known = materialize(known.unionByName(new.join(known.select("package", "id"), ["package", "id"], "left_anti")), "members")
    # What is left climbs to the first ancestor with a path, at most HOPS high.
    lost = named.filter("name IS NOT NULL AND tag NOT IN ('impl', 'use')").join(known.select("package", "id"), ["package", "id"], "left_anti")
    steps = up.join(named.select("package", F.col("id").alias("parent"), F.col("name").alias("parent_name")), ["package", "parent"], "left").join(known.select("package", F.col("id").alias("parent"), F.col("path").alias("base")), ["package", "parent"], "left")
    climbed = docs.sparkSession.sql(
        f"""WITH RECURSIVE climb(package, id, at, tail, base, hops) AS (
              SELECT package, id, id, name, CAST(NULL AS STRING), 0 FROM {{lost}}
              UNION ALL
              SELECT c.package, c.id, s.parent, CASE WHEN s.base IS NOT NULL OR s.parent_name IS NULL THEN c.tail ELSE concat(s.parent_name, '::', c.tail) END, s.base, c.hops + 1
              FROM climb c JOIN {{steps}} s ON s.package = c.package AND s.id = c.at WHERE c.base IS NULL AND c.hops < {HOPS})
            SELECT package, id, max_by(if(base IS NULL, tail, concat(base, '::', tail)), hops) AS path FROM climb GROUP BY package, id""",
        lost=lost, steps=steps,
    )
    return known.unionByName(climbed)


def convert(docs: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame:
    """Symbol rows in id order: items with path, name and kind, and public re-exports."""
    blanket = rows.filter("tag = 'impl' AND trait_path IS NOT NULL AND (blanket OR synthetic)").select("package", F.explode("members").alias("id"))
    live = rows.join(blanket, ["package", "id"], "left_anti")
    parts = live.select("package", "id", F.posexplode("fields").alias("pos", "field")).join(rows.select("package", F.col("id").alias("field"), F.col("json").alias("field_json")), ["package", "field"], "left")
    parts = parts.groupBy("package", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "field_json"))), lambda x: x["field_json"]).alias("parts"))
    signed = live.filter("kind IS NOT NULL").join(parts, ["package", "id"], "left").withColumn("signature", sig.render_signature(F.col("json"), F.coalesce("parts", F.array().cast("array<string>"))))
    plain = F.concat(F.when(F.col("shown"), "pub ").otherwise(""), _map(SHORT)(F.col("kind")), F.lit(" "), F.col("name"))
    signed = signed.withColumn("signature", F.coalesce("signature", plain))
    columns = ["package", "id", "path", "name", "kind", "signature", "docs", "span", "is_public", "has_body", "feature_gate", "reexport_source", "target"]
    regular = signed.filter("name IS NOT NULL").join(known, ["package", "id"]).withColumn("reexport_source", F.lit(None).cast("string")).withColumn("target", F.lit(None).cast("string")).select(*columns)

    table = docjson.paths(docs).select("package", F.col("id").alias("use_id"), F.col("path").alias("table_path"), _map(SUMMARY_KINDS)(F.col("kind")).alias("table_kind"))
    inside = signed.select("package", F.col("id").alias("use_id"), F.col("kind").alias("in_kind"), F.col("signature").alias("in_signature"), F.col("docs").alias("in_docs"), F.col("has_body").alias("in_body"), F.lit(True).alias("in_package"))
    places = rows.filter("tag = 'module'").select("package", F.col("id").alias("module"), F.explode("members").alias("id")).join(known.select("package", F.col("id").alias("module"), F.col("path").alias("base")), ["package", "module"]).groupBy("package", "id").agg(F.min("base").alias("base"))
    uses = live.filter("tag = 'use' AND NOT is_glob AND shown AND use_name <> ''").join(places, ["package", "id"], "left").join(known.withColumnRenamed("path", "own_path"), ["package", "id"], "left").join(table, ["package", "use_id"], "left").join(inside, ["package", "use_id"], "left")
    path = F.coalesce("own_path", F.concat_ws("::", F.coalesce("base", "package"), "use_name"))
    uses = uses.withColumn("path", path).withColumn("reexport_source", F.coalesce("table_path", "use_source")).filter("path <> reexport_source")
    stub = F.concat(F.lit("pub use "), "reexport_source", F.lit(" as "), "use_name")
    uses = uses.select("package", "id", "path", F.col("use_name").alias("name"), F.coalesce("in_kind", "table_kind", F.lit("Struct")).alias("kind"), F.coalesce("in_signature", stub).alias("signature"), F.coalesce(F.nullif("docs", F.lit("")), "in_docs", F.lit("")).alias("docs"), "span", F.lit(True).alias("is_public"), F.coalesce("in_body", F.lit(False)).alias("has_body"), "feature_gate", "reexport_source", F.when(F.col("in_package"), F.col("use_id")).alias("target"))
    order = Window.partitionBy("package").orderBy(F.expr("try_cast(id AS BIGINT)"), "id")
    return regular.unionByName(uses).withColumn("item_id", F.row_number().over(order).cast("long") - 1).withColumn("summary", T.summary(F.col("docs")))


def link(rows: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(children, trait_impls): ordered members, globs spliced in place, inherent impls after fields; copied onto re-exports."""
    ids = made.select("package", "id", "item_id")
    impls = rows.select("package", F.col("id").alias("owner"), F.posexplode("impls").alias("at", "impl")).join(rows.filter("tag = 'impl'").select("package", F.col("id").alias("impl"), "trait_path", "blanket", "synthetic", "members"), ["package", "impl"])
    direct = rows.filter("tag IN ('module', 'struct', 'enum', 'union', 'trait')").select("package", F.col("id").alias("owner"), "tag", F.posexplode("members").alias("a", "member"))
    globs = rows.filter("tag = 'use' AND is_glob").select("package", F.col("id").alias("member"), "use_id").join(rows.filter("tag = 'module'").select("package", F.col("id").alias("use_id"), F.col("members").alias("spliced")), ["package", "use_id"])
    direct = direct.join(globs.select("package", "member", "spliced"), ["package", "member"], "left")
    direct = direct.select("package", "owner", "a", F.posexplode(F.when((F.col("tag") == "module") & F.col("spliced").isNotNull(), F.col("spliced")).otherwise(F.array("member"))).alias("b", "child"))
    inherent = impls.filter("trait_path IS NULL").select("package", "owner", (F.col("at") + 1_000_000).alias("a"), F.posexplode("members").alias("b", "child"))
    listed = direct.unionByName(inherent)
    kinds = rows.select("package", F.col("id").alias("owner"), F.col("tag").alias("owner_tag"))
    copies = made.filter("target IS NOT NULL").select("package", F.col("target").alias("owner"), F.col("id").alias("copy"))
    copied = listed.join(kinds, ["package", "owner"]).filter("owner_tag <> 'module'").drop("owner_tag").join(copies, ["package", "owner"]).select("package", F.col("copy").alias("owner"), "a", "b", "child")
    edges = listed.unionByName(copied).join(ids.select("package", F.col("id").alias("child"), F.col("item_id").alias("child_id")), ["package", "child"]).join(ids.select("package", F.col("id").alias("owner"), F.col("item_id").alias("parent_id")), ["package", "owner"])
    edges = edges.groupBy("package", "parent_id", "child_id").agg(F.min(F.struct("a", "b")).alias("o"))
    edges = edges.withColumn("pos", F.row_number().over(Window.partitionBy("package", "parent_id").orderBy("o", "child_id")) - 1).select("package", "parent_id", "pos", "child_id")
    traits = impls.filter("trait_path IS NOT NULL AND NOT blanket").select("package", "owner", "at", "trait_path", F.col("synthetic").alias("is_synthetic"))
    traits = traits.unionByName(traits.join(copies, ["package", "owner"]).select("package", F.col("copy").alias("owner"), "at", "trait_path", "is_synthetic"))
    traits = traits.join(ids.select("package", F.col("id").alias("owner"), "item_id"), ["package", "owner"])
    traits = traits.withColumn("pos", F.row_number().over(Window.partitionBy("package", "item_id").orderBy("at", "trait_path")) - 1).select("package", "item_id", "pos", "trait_path", "is_synthetic")
    return edges, traits


def cross_globs(docs: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame:
    """package, parent_path ('' at the root), source_path of public globs that leave the package."""
    globs = rows.filter("tag = 'use' AND is_glob AND shown").select("package", F.col("id").alias("use"), "use_id", "use_source")
    away = globs.join(rows.select("package", F.col("id").alias("use_id")), ["package", "use_id"], "left_anti")
    homes = rows.filter("tag = 'module'").select("package", F.col("id").alias("module"), F.explode("members").alias("use"))
    found = away.join(homes, ["package", "use"]).join(known.select("package", F.col("id").alias("module"), "path"), ["package", "module"], "left")
    parent = F.when(F.col("path").isNull() | (F.col("path") == F.col("package")), "").otherwise(F.col("path"))
    return found.select("package", parent.alias("parent_path"), F.col("use_source").alias("source_path")).distinct()


def build_index(docs: DataFrame) -> dict[str, DataFrame]:
    """docs (package, json) -> items, children, trait_impls, glob_uses."""
    rows = materialize(nodes(docs), "nodes")
    known = materialize(item_paths(docs, rows, materialize(parents(rows), "parents")), "paths")
    made = materialize(convert(docs, rows, known), "symbols")
    edges, traits = link(rows, made)
    return {"items": made.drop("id", "target"), "children": edges, "trait_impls": traits, "glob_uses": cross_globs(docs, rows, known)}
