import json

import pytest
from symbols import document

from symloom.functions import signature as sig
from symloom.operators.store import Store, variant_key
from symloom.plans.engine import Engine, QueryError, check_views, parse_query
from symloom.sources import docjson


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    (folder / "shop.json").write_text(document())
    store = Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    assert store.load(str(folder), "v") is None
    made = Engine.from_json(spark, str(folder), store, "v")
    assert store.load(str(folder), "v") is not None
    return made


@pytest.fixture(scope="module")
def rows(engine):
    return {(r["path"], r["kind"]): r for r in engine.items.collect()}


def test_paths_and_signatures(rows):
    want = {
        ("shop", "Module"): "pub mod shop",
        ("shop::prelude::Stack", "Struct"): "pub struct Stack<T: Clone> { pub size: usize, /* private fields */ }",
        ("shop::add", "Function"): "pub fn add(a: i32, b: i32) -> i32",
        ("shop::gated", "Function"): 'pub unsafe extern "C" fn gated()',
        ("shop::Shape::Circle", "Variant"): "Circle(f64)",
        ("shop::Shape::Box", "Variant"): "Box { w: f64, h: f64 }",
        ("shop::Shape::Dot", "Variant"): "Dot",
        ("shop::Draw", "Trait"): "pub trait Draw: Sized",
        ("shop::Draw::draw", "Function"): "fn draw(&self)",
        ("shop::Thing", "Struct"): "pub use other::Thing as Thing",
        ("shop::prelude::LIMIT", "Constant"): "pub const LIMIT: usize",
    }
    for key, signature in want.items():
        assert rows[key]["signature"] == signature
    assert rows["shop::gated", "Function"]["feature_gate"] == "extra" and rows["shop::Thing", "Struct"]["reexport_source"] == "other::Thing"
    pile = rows["shop::Pile", "Struct"]
    assert pile["docs"] == "A stack." and pile["reexport_source"] is not None and not pile["is_stub"]
    assert not [k for k in rows if k[0].endswith("::from")], "members of blanket impls are dropped"
    assert sorted(r["item_id"] for r in rows.values()) == list(range(len(rows)))


def test_members_follow_their_type(rows):
    assert ("shop::prelude::Stack::push", "Function") in rows and rows["shop::prelude::Stack::push", "Function"]["signature"] == "pub fn push(&mut self, value: T)"


def test_views(engine):
    by = {r["path"]: r for r in engine.items.filter("kind IN ('Module', 'Struct', 'Enum', 'Trait')").collect()}
    texts = {r["item_id"]: r["text"] for r in engine.view(engine.items).collect()}
    stack = texts[by["shop::prelude::Stack"]["item_id"]]
    assert stack.startswith("struct shop::prelude::Stack\n\npub struct Stack<T: Clone>") and "\n\nA stack.\n\nmethods:\n  pub fn len(&self) -> usize\n  pub fn push(&mut self, value: T)" in stack
    assert stack.endswith("\n\ntrait implementations:\n  impl Default\n  impl Send")
    draw = texts[by["shop::Draw"]["item_id"]]
    assert draw.endswith("required methods:\n  fn draw(&self)" + " " * 46 + "Must.\n\nprovided methods:\n  fn clear(&self)" + " " * 45 + "May.")
    shop = texts[by["shop"]["item_id"]]
    assert shop.startswith("crate shop\n\nA shop. It sells\n\nThings\n\nof all kinds.\n\nmodules:\n") and "  Shape                           A shape." in shop
    brief = {r["item_id"]: r["text"] for r in engine.view(engine.items, "brief").collect()}
    assert brief[by["shop::Shape"]["item_id"]] == "enum shop::Shape\n  variant  Box\n  variant  Circle\n  variant  Dot"
    impls = {r["item_id"]: r["text"] for r in engine.view(engine.items, "impls").collect()}
    assert impls[by["shop::prelude::Stack"]["item_id"]].endswith("trait implementations:\n  impl Default\n  impl Send (synthetic)")
    assert impls[by["shop::Draw"]["item_id"]].endswith("No known implementors.")
    lines = [json.loads(r["line"]) for r in engine.view(engine.items.filter("path = 'shop::prelude::Stack'"), "json").collect()]
    assert list(lines[0]) == ["path", "kind", "signature", "doc", "feature_gate", "methods", "trait_impls"] and lines[0]["feature_gate"] is None
    assert [m["name"] for m in lines[0]["methods"]] == ["len", "push"] and lines[0]["trait_impls"] == ["Default", "Send"]


def test_lookup_search_tree(engine):
    got = {r["query_id"]: (r["status"], r["path"]) for r in engine.lookup(["shop::stack::push", "shop::add", "shop::nope"]).collect()}
    assert got == {0: ("Found", "shop::prelude::Stack::push"), 1: ("Found", "shop::add"), 2: ("NotFound", None)}
    assert engine.search("stack", "shop", "struct").first()["score"] == 100
    assert "shop::prelude::Stack" in {r["path"] for r in engine.tree("shop").collect()}
    assert {r["path"] for r in engine.tree("shop", "enum").collect()} == {"shop::Shape"}
    assert [(r["parent_path"], r["source_path"]) for r in engine.globs.collect()] == [("", "other")]


def test_types():
    path = lambda p, args=None: {"resolved_path": {"path": p, "id": 1, "args": args}}
    angle = {"angle_bracketed": {"args": [{"lifetime": "'a"}, {"type": {"primitive": "u8"}}, {"const": {"expr": "4"}}, "infer"], "constraints": [{"name": "Item", "args": None, "binding": {"equality": {"type": {"generic": "T"}}}}]}}
    bound = {"trait_bound": {"trait": {"path": "Fn", "id": 1, "args": {"parenthesized": {"inputs": [{"primitive": "u8"}], "output": {"tuple": []}}}}, "generic_params": [{"name": "'b", "kind": {"lifetime": {"outlives": []}}}], "modifier": "maybe"}}
    cases = {
        "Vec<'a, u8, 4, _, Item = T>": path("Vec", angle),
        "&'a mut [u8]": {"borrowed_ref": {"lifetime": "'a", "is_mutable": True, "type": {"slice": {"primitive": "u8"}}}},
        "*const [u8; 3]": {"raw_pointer": {"is_mutable": False, "type": {"array": {"type": {"primitive": "u8"}, "len": "3"}}}},
        "(u8)": {"tuple": [{"primitive": "u8"}]},
        "()": {"tuple": []},
        "impl for<'b> ?Fn(u8) -> () + 'static": {"impl_trait": [bound, {"outlives": "'static"}]},
        "dyn Any + 'a": {"dyn_trait": {"traits": [{"trait": {"path": "Any", "id": 1, "args": None}, "generic_params": []}], "lifetime": "'a"}},
        "unsafe fn(u8, ...)": {"function_pointer": {"sig": {"inputs": [["_", {"primitive": "u8"}]], "output": None, "is_c_variadic": True}, "generic_params": [], "header": {"is_const": False, "is_unsafe": True, "is_async": False, "abi": "Rust"}}},
        "<T as Iterator>::Item": {"qualified_path": {"name": "Item", "args": None, "self_type": {"generic": "T"}, "trait": {"path": "Iterator", "id": 1, "args": None}}},
        "_": "infer",
    }
    for want, node in cases.items():
        assert sig.type_(node) == want


def test_requests():
    assert parse_query("a@1.2::b::c") == ("versioned", "a", "1.2", ["b", "c"]) and parse_query(" ") == ("current", "", None, [])
    for bad in ("@1::x", "a@::x"):
        with pytest.raises(QueryError):
            parse_query(bad)
    with pytest.raises(QueryError):
        check_views("brief", "json", "docs")
    check_views("json", "recursive", "brief")
    assert variant_key() == "" and variant_key(private=True) == "-priv" and variant_key(["b", "a"]) == variant_key(["a", "b"]) != ""


def test_deep_documents():
    deep = '{"a":' * 5000 + "1" + "}" * 5000
    node = docjson.parse_deep(deep)
    for _ in range(5000):
        node = node["a"]
    assert node == 1
    with pytest.raises(ValueError):
        docjson.parse_deep("{")
