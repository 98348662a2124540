import pytest
from symbols import ask, index

from symloom.operators import lookup as L
from symloom.operators import recover, suggest

X1 = [("tokio", "Module"), ("tokio::sync", "Module"), ("tokio::sync::Mutex", "Struct"), ("tokio::sync::RwLock", "Struct"), ("tokio::spawn", "Function"), ("tokio::Runtime", "Struct"), ("tokio::runtime::Builder", "Struct"), ("tokio::runtime::MAX_THREADS", "Constant")]


def answers(spark, rows, texts, package, kf=None):
    items, _ = index(spark, rows)
    out = {}
    for r in L.lookup(ask(spark, texts, package, kf), items).orderBy("query_id", "rank").collect():
        out.setdefault(texts[r["query_id"]], (r["status"], []))[1].append(r["item_id"])
    return out


def test_stages(spark):
    got = answers(spark, X1, ["tokio::sync::Mutex", "tokio", "mutex", "tokio::sync::mutex", "sync::Mutex", "sync::mutex", "NonexistentItem", "sync::MUTEX", ""], "tokio")
    assert got == {"tokio::sync::Mutex": ("Found", [2]), "tokio": ("Found", [0]), "mutex": ("Found", [2]), "tokio::sync::mutex": ("Found", [2]), "sync::Mutex": ("Found", [2]), "sync::mutex": ("Found", [2]), "NonexistentItem": ("NotFound", [None]), "sync::MUTEX": ("NotFound", [None]), "": ("NotFound", [None])}


@pytest.mark.parametrize(
    "rows,text,kf,want",
    [
        ([("m::sync::sync", "Function"), ("m::sync", "Module")], "sync", None, ("Found", [1])),
        ([("m::Foo", "Struct"), ("m::Foo", "Function")], "m::Foo", "Struct", ("Found", [0])),
        ([("m::Foo", "Struct"), ("m::Foo", "Function")], "m::Foo", "Function", ("Found", [1])),
        ([("m::Foo", "Module")], "m::Foo", "Function", ("NotFound", [None])),
        ([("m::http::Builder", "Struct"), ("m::runtime::Builder", "Struct")], "Builder", None, ("Ambiguous", [0, 1])),
        ([("m::Deserialize", "Trait"), ("m::de::Deserialize", "Macro")], "Deserialize", None, ("Found", [0])),
        ([("m::Widget", "Struct"), ("m::ui::Widget", "Struct")], "Widget", None, ("Ambiguous", [0, 1])),
        ([("m::Foo", "Struct")] * 3, "m::Foo", None, ("Found", [0])),
        ([("m::inner::Widget", "Struct"), ("m::inner::Widget::go", "Function"), ("m::Widget", "Struct", {"signature": "pub use inner::Widget"})], "Widget", None, ("Found", [0])),
        ([("m::inner::Helper", "Struct"), ("m::inner::Helper::go", "Function"), ("m::Helper", "Struct", {"reexport_source": "m::inner::Helper"})], "Helper", None, ("Found", [2])),
        ([("m::a::b::Foo", "Struct"), ("m::a::Foo", "Struct", {"reexport_source": "m::a::b::Foo"}), ("m::Foo", "Struct", {"reexport_source": "m::a::b::Foo"})], "Foo", None, ("Found", [2])),
    ],
)
def test_classification(spark, rows, text, kf, want):
    assert answers(spark, rows, [text], "m", kf)[text] == want


def test_ladder_methods_and_kind_relaxation(spark):
    items, edges = index(spark, [("m", "Module"), ("m::Stack", "Struct"), ("m::Stack::push", "Function"), ("m::Stack::pop", "Function"), ("m::util", "Module")])
    rows = [(0, "m", [], "Function"), (1, "m", ["Stack"], "Function"), (2, "m", ["stack", "PUSH"], None), (3, "m", ["Stack", "push"], "Function"), (4, "m", ["Stack", "none"], None)]
    queries = spark.createDataFrame(rows, "query_id long, package string, segments array<string>, kf string")
    got = {r["query_id"]: (r["status"], r["item_id"]) for r in L.resolve(queries, items, edges).collect()}
    assert got == {0: ("Found", 0), 1: ("Found", 1), 2: ("NotFound", None), 3: ("Found", 2), 4: ("NotFound", None)}
    asked = spark.createDataFrame([(4, "m", 1, "pusj")], "query_id long, package string, parent_id long, method string")
    assert [r["path"] for r in suggest.child_suggestions(asked, items, edges).collect()] == ["m::Stack::push", "m::Stack::pop"]


def test_suggestions_are_five_nearest(spark):
    items, _ = index(spark, [("m", "Module"), *((f"m::Foo{i}", "Struct") for i in range(8)), ("m::Bar", "Struct")])
    got = [r["path"] for r in suggest.suggestions(ask(spark, ["Fooo"], "m").select("query_id", "package", "text"), items).orderBy("rank").collect()]
    assert got == [f"m::Foo{i}" for i in range(5)]


def test_recovery(spark):
    rows = [("p", "Module"), ("p::wrap", "Module"), ("p::wrap::Thing", "Struct", {"signature": "pub use q::Thing as Thing", "reexport_source": "q::Thing"}), ("q", "Module"), ("q::Thing", "Struct"), ("q::Thing::new", "Function"), ("q::CONST", "Constant"), ("p::real::Helper", "Struct")]
    items, edges = index(spark, rows)
    globs = spark.createDataFrame([("p", "wrap", "q")], "package string, parent_path string, source_path string")
    queries = spark.createDataFrame([(0, "p", ["wrap", "Thing", "new"], None), (1, "p", ["wrap", "CONST"], None), (2, "p", ["wrong", "Helper"], None), (3, "p", ["nowhere"], None)], "query_id long, package string, segments array<string>, kf string")
    got = {r["query_id"]: (r["status"], r["item_id"], r["rung"]) for r in recover.recover(queries, items, edges, globs).collect()}
    assert got == {0: ("Found", 5, "prefix"), 1: ("Found", 6, "glob"), 2: ("Found", 7, "name"), 3: ("NotFound", None, None)}
    stubs = items.filter("is_stub").select("item_id", "reexport_source", "signature").withColumnRenamed("item_id", "query_id")
    assert [r["item_id"] for r in recover.follow(stubs, items).collect()] == [4]


def test_batch_equals_single_and_order_of_rows_is_free(spark):
    items, _ = index(spark, X1)
    texts = ["mutex", "sync", "builder", "Runtime", "x"]
    together = {(r["query_id"], r["status"], r["item_id"]) for r in L.lookup(ask(spark, texts, "tokio"), items).collect()}
    shuffled = items.repartition(7, "name")
    single = {(i, r["status"], r["item_id"]) for i, t in enumerate(texts) for r in L.lookup(ask(spark, [t], "tokio"), shuffled).collect()}
    assert together == single
