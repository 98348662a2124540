"""Which package a name means, and which version a partial version means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import text as T


def resolve(names: DataFrame, current: DataFrame, direct: DataFrame, members: DataFrame, everything: DataFrame) -> DataFrame:
    """name -> source_type, package: the current package, a direct dependency by its local name, a workspace
    member, any package of the graph, the standard library, else external. The tables hold (pos, name, package)."""
    asked = names.select("name", T.package_key(F.col("name")).alias("key")).distinct()
    hits = None
    for rank, (kind, rows) in enumerate([("Current", current), ("Dependency", direct), ("Member", members), ("Graph", everything)]):
        known = rows.groupBy(T.package_key(F.col("name")).alias("key")).agg(F.min(F.struct("pos", "package")).alias("f")).select("key", F.lit(rank).alias("rank"), F.lit(kind).alias("source_type"), F.col("f.package").alias("package"))
        hits = known if hits is None else hits.unionByName(known)
    best = hits.groupBy("key").agg(F.min(F.struct("rank", "source_type", "package")).alias("b"))
    out = asked.join(best, "key", "left")
    other = F.when(T.is_stdlib(F.col("name")), "Stdlib").otherwise("External")
    return out.select("name", F.coalesce("b.source_type", other).alias("source_type"), F.coalesce("b.package", "name").alias("package"))


def reinterpret(resolved: DataFrame) -> DataFrame:
    """An external bare name that looks like a symbol is one of the current package."""
    return resolved.withColumn("as_item", (F.col("source_type") == "External") & T.looks_like_item(F.col("name")))


def version_key(num: Column) -> Column:
    """Semantic-version order as a comparable struct: a release follows its pre-releases, whose
    identifiers compare as numbers where both are, numbers before words."""
    plain = F.regexp_replace(num, r"\+.*$", "")
    release = F.split(F.regexp_replace(plain, "-.*$", ""), r"\.")
    part = lambda i: F.coalesce(F.try_element_at(release, F.lit(i)).cast("long"), F.lit(0).cast("long"))
    pre = F.when(F.contains(plain, F.lit("-")), F.split(F.regexp_replace(plain, "^[^-]*-", ""), r"\.")).otherwise(F.array().cast("array<string>"))
    keys = F.transform(pre, lambda x: F.struct((~x.rlike("^[0-9]+$")).cast("int").alias("word"), F.when(x.rlike("^[0-9]+$"), x.cast("decimal(38,0)")).alias("number"), x.alias("text")))
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), (F.size(pre) == 0).alias("final"), keys.alias("pre"))


def resolve_version(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """package, wanted -> version: the newest match that is not yanked of one or two numbers; anything else as it stands."""
    partial = F.col("wanted").rlike(r"^[0-9]+(\.[0-9]+)?$")
    live = versions.filter("NOT yanked").withColumn("key", version_key(F.col("num")))
    want = F.split("wanted", r"\.")
    fits = (F.col("key.major") == F.get(want, F.lit(0)).cast("long")) & (F.get(want, F.lit(1)).isNull() | (F.col("key.minor") == F.get(want, F.lit(1)).cast("long")))
    best = asked.filter(partial).join(live, "package").filter(fits).groupBy("package", "wanted").agg(F.max_by("num", "key").alias("version"))
    return asked.join(best, ["package", "wanted"], "left").withColumn("version", F.when(partial, F.col("version")).otherwise(F.col("wanted")))


def current_package(members: DataFrame, root: Column, cwd: Column) -> DataFrame:
    """The root package if there is one, else the member nearest to the working directory, else the first (pos, package, path)."""
    gap = T.path_gap(F.col("path"), cwd)
    order = Window.orderBy(F.when(F.col("package") == root, 0).otherwise(1), gap, "pos")  # a workspace's members, not a corpus
    return members.withColumn("r", F.row_number().over(order)).filter("r = 1").select("package")


def choose_variant(variants: DataFrame) -> DataFrame:
    """package -> the variant of the best strategy that exists (explicit, documented, all, default)."""
    order = F.create_map(*[F.lit(x) for kv in {"explicit": 0, "documented": 1, "all": 2, "default": 3}.items() for x in kv])
    best = F.min(F.struct(F.element_at(order, F.col("strategy")).alias("o"), F.col("variant_key").alias("v")))
    return variants.groupBy("package").agg(best.alias("b")).select("package", F.col("b.v").alias("variant_key"))
