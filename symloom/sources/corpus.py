"""A symbol corpus over the star-schema tables: regions, nations, customers, suppliers, parts and orders as
documented symbols of the package ``tpch``, and the suppliers once more in ``tpch_ext``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.operators.index import derive
from symloom.operators.store import materialize

PACKAGE, EXTENSION = "tpch", "tpch_ext"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _symbols(rows: DataFrame, path: Column, name: Column, kind: str, signature: Column, docs: Column | None = None, public: Column | None = None, body: Column | None = None, source: Column | None = None, key: Column | None = None) -> DataFrame:
    return rows.select(path.alias("path"), name.alias("name"), F.lit(kind).alias("kind"), signature.alias("signature"), (F.lit("") if docs is None else F.coalesce(docs, F.lit(""))).alias("docs"), (F.lit(True) if public is None else public).alias("is_public"), (F.lit(True) if body is None else body).alias("has_body"), (F.lit(None).cast("string") if source is None else source).alias("reexport_source"), (F.lit(0).cast("long") if key is None else key.cast("long")).alias("k"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", F.concat_ws("::", F.lit(PACKAGE), "r_name", "n_name").alias("place"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their symbol path."""
    return read(spark, sf_dir, "customer").join(_places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("path", F.concat_ws("::", "place", "c_name"))


def raw_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, one = F.lit(PACKAGE), spark.range(1)
    mod = lambda name: F.concat(F.lit("pub mod "), name)
    places, people = _places(spark, sf_dir), customers(spark, sf_dir)
    texts = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("doc_text"))
    count = read(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"))
    told = people.crossJoin(F.broadcast(count)).withColumn("doc_id", F.col("c_custkey") % F.col("n_docs")).join(texts, "doc_id", "left")  # one row of counts
    parts = read(spark, sf_dir, "part").withColumn("part_name", F.translate("p_name", " ", "_"))
    sold = read(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    placed = read(spark, sf_dir, "orders").join(people.select("c_custkey", "path"), F.col("o_custkey") == F.col("c_custkey")).withColumn("order_name", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")))
    segment = F.concat(F.lit("pub struct "), "c_name", F.lit("<"), "c_mktsegment", F.lit(">"))
    stubs = people.filter(F.col("c_mktsegment") == "BUILDING")
    made = [
        _symbols(one, root, root, "Module", mod(root)),
        _symbols(one, F.lit(f"{PACKAGE}::parts"), F.lit("parts"), "Module", mod(F.lit("parts"))),
        _symbols(one, F.lit(f"{PACKAGE}::prelude"), F.lit("prelude"), "Module", mod(F.lit("prelude"))),
        _symbols(read(spark, sf_dir, "region"), F.concat_ws("::", root, "r_name"), F.col("r_name"), "Module", mod(F.col("r_name"))),
        _symbols(places, F.col("place"), F.col("n_name"), "Module", mod(F.col("n_name"))),
        _symbols(told, F.col("path"), F.col("c_name"), "Struct", segment, F.col("doc_text"), F.col("c_acctbal") >= 0, key=F.col("c_custkey")),
        _symbols(sold, F.concat_ws("::", "place", "s_name"), F.col("s_name"), "Trait", F.concat(F.lit("pub trait "), "s_name"), key=F.col("s_suppkey")),
        _symbols(parts.select("p_type").distinct(), F.concat_ws("::", root, F.lit("parts"), "p_type"), F.col("p_type"), "Module", mod(F.col("p_type"))),
        _symbols(parts, F.concat_ws("::", root, F.lit("parts"), "p_type", "part_name"), F.col("part_name"), "Function", F.concat(F.lit("pub fn "), "part_name", F.lit("(size: "), F.col("p_size").cast("string"), F.lit(") -> "), "p_brand"), key=F.col("p_partkey")),
        _symbols(placed, F.concat_ws("::", "path", "order_name"), F.col("order_name"), "Function", F.concat(F.lit("pub fn "), "order_name", F.lit("(&self)")), body=F.col("o_orderstatus") == "F", key=F.col("o_orderkey")),
        _symbols(stubs, F.concat_ws("::", root, F.lit("prelude"), "c_name"), F.col("c_name"), "Struct", F.concat(F.lit("pub use "), "path", F.lit(" as "), "c_name"), source=F.col("path"), key=F.col("c_custkey")),
    ]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.withColumn("package", root)


def extension_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.lit(EXTENSION)
    suppliers = read(spark, sf_dir, "supplier")
    out = _symbols(spark.range(1), root, root, "Module", F.concat(F.lit("pub mod "), root))
    return out.unionByName(_symbols(suppliers, F.concat_ws("::", root, "s_name"), F.col("s_name"), "Struct", F.concat(F.lit("pub struct "), "s_name"), key=F.col("s_suppkey"))).withColumn("package", root)


def items(spark: SparkSession, sf_dir: str, extension: bool = False) -> DataFrame:
    """Symbol rows with ids by path, kind and key within a package, and the derived columns of ``derive``."""
    rows = raw_symbols(spark, sf_dir)
    if extension:
        rows = rows.unionByName(extension_symbols(spark, sf_dir))
    return derive(numbered(rows, ["path", "kind", "k"]).drop("k"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``item_id``, the place in ``order`` within the package. Rows are dealt by range and each range numbered on its own."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, "package", *order).withColumn("part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("package", "part").agg(F.count("*").alias("n"))
    before = sizes.select("package", "part", (F.sum("n").over(Window.partitionBy("package").orderBy("part")) - F.col("n")).alias("before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("package", "part").orderBy(*order))
    return dealt.join(before, ["package", "part"]).withColumn("item_id", F.col("before") + place.cast("long") - 1).drop("part", "before")


def trait_impls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path of a customer, trait_path (order priority), is_synthetic."""
    placed = read(spark, sf_dir, "orders").join(customers(spark, sf_dir).select("c_custkey", "path"), F.col("o_custkey") == F.col("c_custkey"))
    return placed.select("path", F.col("o_orderpriority").alias("trait_path")).distinct().withColumn("is_synthetic", F.col("trait_path") >= "4")
