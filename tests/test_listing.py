from symbols import SCHEMA, index

from symloom.operators import listing, packages, render, store
from symloom.streaming import search as stream


def test_tree_visits_twins_once_and_hides_private(spark):
    rows = [("m", "Module"), ("m::a", "Module"), ("m::a", "Module"), ("m::a::f", "Function"), ("m::a::f", "Function"), ("m::a::b", "Module"), ("m::a::b::S", "Struct"), ("m::a::b::S::go", "Function"), ("m::p", "Module", {"is_public": False}), ("m::p::x", "Function")]
    items, edges = index(spark, rows)
    got = sorted((r["path"], r["kind"], r["level"]) for r in listing.tree(items, edges, "m").collect())
    assert got == [("m::a", "Module", 1), ("m::a::b", "Module", 2), ("m::a::b::S", "Struct", 3), ("m::a::f", "Function", 2)]
    assert [r["path"] for r in listing.tree(items, edges, "m", "Function").collect()] == ["m::a::f"]
    assert "m::p::x" in {r["path"] for r in listing.tree(items, edges, "m", None, True).collect()}


def test_listing_keeps_trailing_blanks(spark):
    items, _ = index(spark, [("m::long_name", "Struct", {"signature": "pub struct X"}), ("m::f", "Function", {"feature_gate": "g"}), ("m::h", "Function")])
    assert render.listed(items).first()["lines"] == "m:\n  fn      m::f                         [feature: g]\n  fn      m::h        \n  struct  m::long_name  pub struct X".replace("                         [", " " * 10 + " " * 12 + "    [")


def test_source_and_readme(spark):
    files = spark.createDataFrame([("a.rs", "1\n2\n3\n4")], "file string, text string")
    spans = spark.createDataFrame([("a.rs", 2, 3), ("a.rs", 0, 0), ("a.rs", 4, 9), ("b.rs", 1, 1)], "file string, line_start int, line_end int")
    assert {r["line_start"]: r["source"] for r in listing.source_slice(files, spans).collect()} == {2: "2\n3", 4: "4"}
    read = spark.createDataFrame([("p", "readme.txt", "t"), ("p", "README.md", "m"), ("q", "other", "o")], "package string, file string, text string")
    assert [(r["package"], r["text"]) for r in listing.readme(read, ["README.md", "readme.txt"]).collect()] == [("p", "m")]


def test_current_package(spark):
    members = spark.createDataFrame([(0, "a", "/w/a"), (1, "b", "/w/b"), (2, "c", "/w/b/c")], "pos int, package string, path string")
    from pyspark.sql import functions as F

    assert packages.current_package(members, F.lit("none"), F.lit("/w/b/x")).first()["package"] == "b"
    assert packages.current_package(members, F.lit("c"), F.lit("/w")).first()["package"] == "c"


def test_store_ignores_other_versions(spark, tmp_path):
    kept = store.Store(spark, f"file://{tmp_path}/s")
    kept.save("p", "k", {"t": spark.range(3)})
    assert kept.load("p", "k")["t"].count() == 3 and kept.load("p", "other") is None
    kept.save("p", "k", {"t": spark.range(5)})
    assert kept.get("p", "k", lambda: 1 / 0)["t"].count() in (3, 5)
    kept.clear()
    assert kept.load("p", "k") is None


def test_stream(spark, tmp_path):
    rows = [("p", 0, "p::Mutex", "Mutex", "Struct", "", "", "", True, True, None, None), ("p", 1, "p::x", "x", "Struct", "", "", "", True, True, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in")
    query = stream.hits(spark, f"{tmp_path}/in", SCHEMA, "mutex").writeStream.format("memory").queryName("found").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    assert query.awaitTermination(60)
    assert [(r["path"], r["score"]) for r in spark.table("found").collect()] == [("p::Mutex", 100)]
