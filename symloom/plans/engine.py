"""One object for an index: lookups, searches, listings and views, each a DataFrame plan over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom import schemas
from symloom.operators import build, index, listing, packages, recover, render, search, suggest
from symloom.operators.store import Store, fingerprint, materialize
from symloom.sources import docjson

# Views that exclude each other.
CONFLICTS = {
    "brief": {"docs", "source", "search", "impls", "impls_of"},
    "docs": {"brief", "search", "impls", "impls_of"},
    "source": {"brief", "impls", "impls_of"},
    "search": {"brief", "docs", "source", "impls"},
    "impls": {"brief", "docs", "source"},
    "impls_of": {"brief", "docs", "source", "impls"},
    "recursive": {"impls", "impls_of", "search"},
    "readme": {"source", "search", "impls", "impls_of", "recursive"},
}


class EngineError(Exception):
    """Anything that keeps the engine from answering; 1 where a package or symbol was not found, else 2."""

    exit_code = 2


class QueryError(EngineError, ValueError):
    """An invalid request."""


class PackageNotFound(EngineError, LookupError):
    """A package or version that the index does not hold."""

    exit_code = 1


def check_views(*views: str) -> None:
    chosen = set(views)
    for v in views:
        if clash := CONFLICTS.get(v, set()) & chosen:
            raise QueryError(f"{v} cannot be combined with {', '.join(sorted(clash))}")


def parse_query(text: str) -> tuple[str, str, str | None, list[str]]:
    """(spec, package, version, segments) of ``package[@version](::segment)*``; empty text is the current package."""
    text = text.strip()
    if not text:
        return "current", "", None, []
    head, *segments = text.split("::")
    name, at, version = head.partition("@")
    if at and not name:
        raise QueryError("a version needs a package name before '@'")
    if at and not version:
        raise QueryError("empty version after '@'")
    return ("versioned" if at else "named"), name, version or None, segments


class Engine:
    def __init__(self, spark: SparkSession, items: DataFrame, children: DataFrame, trait_impls: DataFrame, glob_uses: DataFrame):
        self.spark, self.edges, self.trait_impls, self.globs = spark, children, trait_impls, glob_uses
        self.items = materialize(index.with_stubs(index.derive(items), children), "items")

    @classmethod
    def from_json(cls, spark: SparkSession, path: str, store: Store | None = None, key: str = "") -> Engine:
        """Builds the index of all documentation files under ``path``, or takes it from the store while the files are unchanged."""
        tables = (lambda: build.build_index(docjson.read(spark, path)))
        made = store.get(path, key, tables, fingerprint(spark, [path])) if store else tables()
        return cls(spark, **{"items": made["items"], "children": made["children"], "trait_impls": made["trait_impls"], "glob_uses": made["glob_uses"]})

    def versions(self) -> DataFrame:
        """package, num, yanked of the packages that are held by version (named ``package@version``)."""
        held = self.items.select("package").distinct().filter(F.contains("package", F.lit("@")))
        return held.select(F.substring_index("package", "@", 1).alias("package"), F.substring_index("package", "@", -1).alias("num"), F.lit(False).alias("yanked"))

    def queries(self, texts: list[str], kind: str | None = None, current: str = "") -> DataFrame:
        """query_id, package, segments, kf. ``package@version`` means that snapshot; a partial version means its newest."""
        parsed = [parse_query(t) for t in texts]
        asked = {(package, version) for _, package, version, _ in parsed if version}
        named = {}
        if asked:
            wanted = self.spark.createDataFrame(sorted(asked), "package string, wanted string")
            named = {(r["package"], r["wanted"]): r["version"] for r in packages.resolve_version(wanted, self.versions()).collect()}  # one row a query
            lost = [f"{p}@{v}" for (p, v), found in named.items() if found is None]
            if lost:
                raise PackageNotFound(", ".join(sorted(lost)))
        rows = [(i, f"{package}@{named[package, version]}" if version else package or current, segments, schemas.kind_option(kind)) for i, (_, package, version, segments) in enumerate(parsed)]
        return self.spark.createDataFrame(rows, "query_id long, package string, segments array<string>, kf string")

    def lookup(self, texts: list[str], kind: str | None = None, current: str = "") -> DataFrame:
        return recover.recover(self.queries(texts, kind, current), self.items, self.edges, self.globs)

    def answers(self, texts: list[str], kind: str | None = None, current: str = "") -> DataFrame:
        """query_id, status, text: the view of what was found, the choice where it is ambiguous, else a message with suggestions."""
        asked = self.queries(texts, kind, current)
        named = asked.withColumn("text", F.array_join("segments", "::"))
        hits = materialize(recover.recover(asked, self.items, self.edges, self.globs), "answers")
        one = hits.filter("status = 'Found'").select("query_id", "path", "item_id", "kind")
        shown = one.join(asked.select("query_id", F.col("package").alias("own")), "query_id").join(self.items.select("package", "item_id", "path", "kind"), ["item_id", "path", "kind"])
        first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("package") != F.col("own"), "package"))  # snapshots of several versions share paths
        shown = shown.withColumn("first", first).filter("first = 1")
        found = shown.select("query_id", "package", "item_id").join(self.view(shown.select("package", "item_id")), ["package", "item_id"]).select("query_id", F.lit("Found").alias("status"), "text")
        many = render.ambiguous(hits, self.items, named).select("query_id", F.lit("Ambiguous").alias("status"), "text")
        lost = suggest.not_found(named, hits, self.items).select("query_id", F.lit("NotFound").alias("status"), F.col("message").alias("text"))
        return found.unionByName(many).unionByName(lost)

    def suggest(self, unmatched: DataFrame) -> DataFrame:
        return suggest.suggestions(unmatched, self.items)

    def search(self, query: str, package: str | None = None, kind: str | None = None) -> DataFrame:
        items = self.items if package is None else self.items.filter(F.col("package") == package)
        return search.search(items, query, schemas.kind_option(kind))

    def search_view(self, query: str, package: str | None = None, kind: str | None = None, mode: str = "text") -> DataFrame:
        """The hits as one text, or as a JSON object each."""
        hits = self.search(query, package, kind)
        return search.as_json(hits) if mode == "json" else search.as_text(hits, query)

    def tree(self, path: str, kind: str | None = None, include_private: bool = False) -> DataFrame:
        return listing.tree(self.items, self.edges, path, schemas.kind_option(kind), include_private)

    def tree_view(self, path: str, mode: str = "text", kind: str | None = None, include_private: bool = False) -> DataFrame:
        """text, brief or docs of everything below a module, a row for each module in it; or a JSON object for each symbol."""
        below = self.tree(path, kind, include_private).select("package", "item_id")
        rows = self.items.join(below, ["package", "item_id"], "left_semi")
        if mode == "json":
            return render.json_list(rows, "package", "item_id", "path")
        if mode == "docs":
            return render.documented(rows)
        if mode in ("text", "brief"):
            return render.listed(rows, names_only=mode == "brief")
        raise QueryError(f"unknown view {mode!r}")

    def source(self, files: DataFrame, wanted: DataFrame, kind: str | None = None, with_docs: bool = False) -> DataFrame:
        """key, text: the source of each of ``wanted`` (key, rank, package, item_id) from files (package, file, text);
        with ``kind``, a module stands for its public children of that kind."""
        group = schemas.kind_option(kind)
        if group:
            modules = wanted.join(self.items.filter("kind = 'Module'").select("package", "item_id"), ["package", "item_id"], "left_semi")
            kids = listing.children_of(self.items, self.edges, modules, group).select("package", "parent_id", "pos", "item_id")
            inner = modules.withColumnRenamed("item_id", "parent_id").join(kids, ["package", "parent_id"]).select("key", F.col("pos").alias("rank"), "package", "item_id")
            wanted = wanted.join(modules, ["package", "item_id"], "left_anti").select("key", "rank", "package", "item_id").unionByName(inner)
        return render.sources_of(wanted, self.items, files, with_docs)

    def source_tree(self, files: DataFrame, path: str, kind: str | None = None, with_docs: bool = False) -> DataFrame:
        """key, text: the sources of everything but modules below a module, between rules."""
        below = self.tree(path, kind).filter("kind <> 'Module'")
        rank = F.row_number().over(Window.partitionBy("package").orderBy("path", "level", "item_id"))
        return render.sources_of(below.select("package", "item_id", rank.alias("rank")).withColumn("key", F.lit(path)), self.items, files, with_docs, ruled=True)

    def workspace(self, members: list[str], mode: str = "text") -> DataFrame:
        """package, status and view (text) of the root of every member at once; a member without an index is Missing."""
        asked = self.spark.createDataFrame([(m,) for m in sorted(set(members))], "package string")
        roots = self.items.filter("depth = 1 AND kind = 'Module'").join(asked, "package", "left_semi").groupBy("package").agg(F.min("item_id").alias("item_id"))
        views = self.view(materialize(roots, "roots"), mode).select("package", "text")
        return asked.join(views, "package", "left").select("package", F.when(F.col("text").isNull(), "Missing").otherwise("Found").alias("status"), "text")

    def view(self, wanted: DataFrame, mode: str = "text", **options) -> DataFrame:
        """text, brief, json or impls of ``wanted`` (package, item_id)."""
        if mode == "json":
            return render.json_items(self.items, self.edges, self.trait_impls, wanted, **options)
        if mode == "brief":
            return render.brief(self.items, self.edges, wanted, **options)
        if mode == "impls":
            return render.impls_view(self.items, self.trait_impls, wanted, **options)
        if mode == "text":
            return render.text(self.items, self.edges, self.trait_impls, wanted, **options)
        raise QueryError(f"unknown view {mode!r}")
