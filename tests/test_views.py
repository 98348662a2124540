import json

from symbols import ask, index

from symloom.operators import recover, render, suggest
from symloom.operators import search as S

ROWS = [
    ("t", "Module"), ("t::Ser", "Trait", {"summary": "A trait.", "signature": "pub trait Ser", "docs": "A trait. More.\n\nRest."}), ("t::m::Ser", "ProcMacro", {"summary": ""}),
    ("t::a::run", "Function", {"signature": "pub fn run()", "docs": "Runs **it**."}), ("t::b::run", "Function"), ("t::b::c::d::run", "Function", {"summary": "Deep."}), ("t::E::run", "Variant"),
    *[(f"t::x{i}::many", "Struct", {"summary": f"No {i}."}) for i in range(12)],
]


def hits(spark, rows):
    return spark.createDataFrame([(q, "Ambiguous", n + 1, i, "", "") for q, ids in rows.items() for n, i in enumerate(ids)], "query_id long, status string, rank int, item_id long, path string, kind string")


def test_ambiguous_forms(spark):
    items, _ = index(spark, ROWS)
    asked = ask(spark, ["ser", "run", "many"], "t")
    got = {r["query_id"]: r["text"] for r in render.ambiguous(hits(spark, {0: [1, 2], 1: [3, 4, 5, 6], 2: list(range(7, 19))}), items, asked).collect()}
    assert got[0] == '"ser" matches 2 items:\n\n  trait    Ser                   A trait.\n  proc macro  Ser                 \n\nUse --kind trait or --kind macro to select.'
    assert got[1] == 'Found 4 items matching "run":\n\n--- t::a::run ---\npub fn run()\nRuns it.\n\n--- t::b::run ---\n\nAlso found in nested contexts:\n  fn       t::b::c::d::run' + " " * 23 + "  Deep.\n  variant  t::E::run" + " " * 29
    lines = got[2].split("\n")
    assert lines[0] == 'Found 12 items matching "many":' and lines[2] == "struct   t::x0::many" + " " * 27 + "  No 0." and len(lines) == 13 and lines[-1] == "... (2 more, use a more specific path)"


def test_sources(spark):
    span = lambda file, a, b: (file, a, b)
    rows = [("p", n, f"p::f{n}", f"f{n}", "Function", 2, "Does **it**.", None, s) for n, s in enumerate([span("a.rs", 2, 3), span("a.rs", 1, 1), span("gone.rs", 1, 2), span("", 0, 0), span("a.rs", 9, 12), span("a.rs", 3, 99)])]
    items = spark.createDataFrame(rows, "package string, item_id long, path string, name string, kind string, depth int, docs string, feature_gate string, span struct<file:string,line_start:int,line_end:int>")
    files = spark.createDataFrame([("p", "a.rs", "one\r\ntwo\n  three\n")], "package string, file string, text string")
    got = {r["item_id"]: r["text"] for r in render.sources(items, files, items).collect()}
    assert got == {0: "fn p::f0  a.rs:2-3\ntwo\n  three", 1: "fn p::f1  a.rs:1\none", 2: "// source not available (Could not read gone.rs)", 3: "// source not available (macro-generated or built-in)", 4: "// source not available (Could not read a.rs)", 5: "fn p::f5  a.rs:3-99\n  three"}
    with_docs = render.sources(items, files, items.filter("item_id = 1"), with_docs=True).first()["text"]
    assert with_docs == "fn p::f1  a.rs:1\n\nDoes it.\none"
    keyed = items.filter("item_id < 2").selectExpr("1 AS key", "item_id AS rank", "package", "item_id")
    assert render.sources_of(keyed, items, files).first()["text"] == "--- p::f0 ---\nfn p::f0  a.rs:2-3\ntwo\n  three\n\n--- p::f1 ---\nfn p::f1  a.rs:1\none"
    assert render.sources_of(keyed, items, files, ruled=True).first()["text"] == "fn p::f0  a.rs:2-3\ntwo\n  three\n\n" + "─" * 40 + "\n\nfn p::f1  a.rs:1\none"


def test_recursive_docs_and_json(spark):
    items, _ = index(spark, [("t", "Module"), ("t::S", "Struct", {"signature": "pub struct S", "docs": "One.\n\nTwo.", "feature_gate": "x"}), ("t::m::f", "Function", {"reexport_source": "u::f"})])
    got = {r["module_path"]: r["lines"] for r in render.documented(items.filter("depth > 1")).collect()}
    assert got == {"t": "t:\n\nstruct  t::S  [feature: x]\n    pub struct S\n\n    One.\n\n    Two.", "t::m": "t::m:\n\nfn  t::m::f"}
    lines = {r["item_id"]: json.loads(r["line"]) for r in render.json_list(items, "item_id").collect()}
    assert lines[2] == {"path": "t::m::f", "kind": "fn", "signature": "", "summary": "", "reexported_from": "u::f"} and "reexported_from" not in lines[1]


def test_search_output_and_hint(spark):
    items, _ = index(spark, [("t", "Module"), ("t::Map", "Struct", {"summary": "Keys."}), ("t::long::HashMap", "Struct"), ("t::map", "Function")])
    assert [r["path"] for r in S.search(items, "map").collect()] == ["t::Map", "t::map", "t::long::HashMap"]
    assert S.as_text(S.search(items, "map"), "map").first()["text"] == '3 results for "map":\n\nstruct  t::Map            Keys.\nfn      t::map          \nstruct  t::long::HashMap'
    assert S.as_text(S.search(items, "zzz"), "zzz").first()["text"] == '0 results for "zzz":'
    first = S.as_json(S.search(items, "map")).first()["line"]
    assert list(json.loads(first)) == ["kind", "path", "score", "signature", "summary"]
    assert S.hint(items.filter("kind = 'Module'"), items, "map").first()["n_wider"] == 3
    assert S.hint(items, items, "map").count() == 0 and S.hint(items, items, "zzz").count() == 0


def test_not_found_messages(spark):
    items, _ = index(spark, [("t", "Module"), ("t::widget", "Function")])
    asked = ask(spark, ["widgit", "qqqqqqqqqq"], "t")
    none = spark.createDataFrame([(0, "NotFound"), (1, "NotFound")], "query_id long, status string")
    got = {r["query_id"]: (r["message"], r["suggestions"], r["exit_code"]) for r in suggest.not_found(asked, none, items).collect()}
    assert got == {0: ("no item matching \"widgit\" in crate 't'\n\nDid you mean:\n  t::widget", ["t::widget"], 1), 1: ("no item matching \"qqqqqqqqqq\" in crate 't'", [], 1)}


def test_several_re_exports_descend(spark):
    """A name found only as re-exports of several things is followed through a stub prefix, else it stays ambiguous."""
    stub = lambda source: {"signature": f"pub use {source} as x", "reexport_source": source}
    rows = [("t", "Module"), ("t::pre", "Struct", stub("u::Thing")), ("t::a::push", "Function", stub("w::push")), ("t::b::push", "Function", stub("v::push")), ("t::c::pull", "Function", stub("w::pull")), ("t::d::pull", "Function", stub("v::pull"))]
    items, edges = index(spark, rows)
    more, below = index(spark, [("u", "Module"), ("u::Thing", "Struct"), ("u::Thing::push", "Function")])
    items, edges = items.unionByName(more), edges.unionByName(below)
    asked = spark.createDataFrame([(0, "t", ["pre", "push"], None), (1, "t", ["pull"], None)], "query_id long, package string, segments array<string>, kf string")
    globs = spark.createDataFrame([], "package string, parent_path string, source_path string")
    got = [(r["query_id"], r["status"], r["path"], r["rung"]) for r in recover.recover(asked, items, edges, globs).orderBy("query_id", "rank").collect()]
    assert got[0] == (0, "Found", "u::Thing::push", "prefix")
    assert [x[:2] for x in got[1:]] == [(1, "Ambiguous")] * 2


def test_engine_answers_versions_trees_and_workspaces(spark):
    from symloom.plans.engine import Engine, PackageNotFound

    rows = []
    for package in ("t@1.0.0", "t@1.2.0", "u"):
        root = package.split("@")[0]
        for n, (path, kind, docs) in enumerate([(root, "Module", ""), (f"{root}::Only", "Struct", f"Of {package}."), (f"{root}::m", "Module", ""), (f"{root}::m::f", "Function", "")]):
            rows.append((package, n, path, path.split("::")[-1], kind, "", docs, docs, ("a.rs", 1, 1), True, True, None, None))
    from symloom import schemas

    items = spark.createDataFrame(rows, schemas.ITEMS)
    edges = spark.createDataFrame([(p, a, n, b) for p in ("t@1.0.0", "t@1.2.0", "u") for a, n, b in ((0, 0, 1), (0, 1, 2), (2, 0, 3))], schemas.CHILDREN)
    engine = Engine(spark, items, edges, spark.createDataFrame([], schemas.TRAIT_IMPLS), spark.createDataFrame([], schemas.GLOB_USES))
    got = {r["query_id"]: (r["status"], r["text"]) for r in engine.answers(["t@1::Only", "t@1.0.0::Only", "u::Onli", "u"]).collect()}
    assert got[0] == ("Found", "struct t::Only\n\n\n\nOf t@1.2.0.") and "Of t@1.0.0." in got[1][1]
    assert got[2][0] == "NotFound" and got[2][1].endswith("Did you mean:\n  u::Only") and got[3][1].startswith("crate u")
    try:
        engine.queries(["t@7::x"])
        raise AssertionError
    except PackageNotFound as lost:
        assert lost.exit_code == 1
    assert {(r["package"], r["status"]) for r in engine.workspace(["u", "gone"]).collect()} == {("u", "Found"), ("gone", "Missing")}
    assert {r["module_path"]: r["lines"] for r in engine.tree_view("u", "brief").collect()} == {"u": "u:\n  struct  Only\n  mod     m", "u::m": "u::m:\n  fn      f"}
    files = spark.createDataFrame([("u", "a.rs", "code")], "package string, file string, text string")
    assert engine.source(files, spark.createDataFrame([(1, 1, "u", 0)], "key int, rank int, package string, item_id long"), "struct").first()["text"] == "--- u::Only ---\nstruct u::Only  a.rs:1\ncode"
    assert engine.source_tree(files, "u").first()["text"].count("code") == 2
