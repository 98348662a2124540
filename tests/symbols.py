"""Small hand-made indexes, and a documentation file in the JSON encoding of the public format."""

import json

from symloom.operators.index import children, derive, with_stubs

SCHEMA = "package string, item_id long, path string, name string, kind string, signature string, docs string, summary string, is_public boolean, has_body boolean, feature_gate string, reexport_source string"


def index(spark, rows):
    """rows: (path, kind, {overrides}); ids in order."""
    made = []
    for n, row in enumerate(rows):
        path, kind, more = (*row, {})[:3]
        base = {"package": path.split("::")[0], "item_id": n, "path": path, "name": path.split("::")[-1], "kind": kind, "signature": "", "docs": "", "summary": "", "is_public": True, "has_body": True, "feature_gate": None, "reexport_source": None}
        made.append(tuple((base | more).values()))
    items = derive(spark.createDataFrame(made, SCHEMA))
    edges = children(items)
    return with_stubs(items, edges), edges


def ask(spark, texts, package, kf=None):
    return spark.createDataFrame([(i, package, t, kf) for i, t in enumerate(texts)], "query_id long, package string, text string, kf string")


def _generics(*names):
    return {"params": [{"name": n, "kind": {"type": {"bounds": b, "default": None, "is_synthetic": False}}} for n, b in names], "where_predicates": []}


def trait(path):
    return {"trait_bound": {"trait": {"path": path, "id": 900, "args": None}, "generic_params": [], "modifier": "none"}}


def item(id_, name, inner, docs="", visibility="public", attrs=(), line=1):
    return {"id": id_, "crate_id": 0, "name": name, "span": {"filename": "src/lib.rs", "begin": [line, 1], "end": [line + 1, 1]}, "visibility": visibility, "docs": docs, "links": {}, "attrs": list(attrs), "deprecation": None, "inner": inner}


def function(inputs, output=None, body=True, generics=None, **header):
    return {"function": {"sig": {"inputs": inputs, "output": output, "is_c_variadic": False}, "generics": generics or _generics(), "header": {"is_const": False, "is_unsafe": False, "is_async": False, "abi": "Rust"} | header, "has_body": body}}


PRIM = lambda n: {"primitive": n}
SELF = {"generic": "Self"}
SELF_REF = {"borrowed_ref": {"lifetime": None, "is_mutable": False, "type": SELF}}


def document():
    """A package ``shop``: containers, a trait, an enum, re-exports inside and across packages, a glob."""
    impl = lambda items, t=None, synthetic=False, blanket=None, owner=("Stack", 3): {"impl": {"is_unsafe": False, "generics": _generics(), "provided_trait_methods": [], "trait": None if t is None else {"path": t, "id": 901, "args": None}, "for": {"resolved_path": {"path": owner[0], "id": owner[1], "args": None}}, "items": items, "is_negative": False, "is_synthetic": synthetic, "blanket_impl": blanket}}
    module = lambda ids: {"module": {"is_crate": False, "items": ids, "is_stripped": False}}
    use = lambda source, name, id_, glob=False: {"use": {"source": source, "name": name, "id": id_, "is_glob": glob}}
    rows = [
        item(0, "shop", module([1, 2, 20, 30, 31, 40, 41, 42, 50]), "A shop. It sells\n\n# Things\n\nof all kinds."),
        item(1, "containers", module([3, 9]), "Containers for **things**."),
        item(2, "add", function([["a", PRIM("i32")], ["b", PRIM("i32")]], PRIM("i32")), "Adds two numbers. Returns the sum."),
        item(3, "Stack", {"struct": {"kind": {"plain": {"fields": [4, 5], "has_stripped_fields": True}}, "generics": _generics(("T", [trait("Clone")])), "impls": [6, 7, 8, 12]}}, "A stack.", line=10),
        item(4, "size", {"struct_field": PRIM("usize")}, "How many."),
        item(5, "inner", {"struct_field": {"generic": "T"}}, visibility="default"),
        item(6, None, impl([10, 11])),
        item(7, None, impl([13], "Default")),
        item(8, None, impl([], "Send", synthetic=True)),
        item(9, "LIMIT", {"constant": {"type": PRIM("usize"), "const": {"expr": "9", "value": None, "is_literal": True}}}, "The limit!"),
        item(10, "push", function([["self", {"borrowed_ref": {"lifetime": None, "is_mutable": True, "type": SELF}}], ["value", {"generic": "T"}]]), "Pushes a value."),
        item(11, "len", function([["self", SELF_REF]], PRIM("usize")), ""),
        item(12, None, impl([14], "From", blanket={"generic": "T"})),
        item(13, "default", function([], SELF), "", visibility="default"),
        item(14, "from", function([["t", {"generic": "T"}]], SELF), "", visibility="default"),
        item(20, "Shape", {"enum": {"generics": _generics(), "has_stripped_variants": False, "variants": [21, 22, 23], "impls": []}}, "A shape."),
        item(21, "Circle", {"variant": {"kind": {"tuple": [24]}, "discriminant": None}}, "Round.", visibility="default"),
        item(22, "Box", {"variant": {"kind": {"struct": {"fields": [25, 26], "has_stripped_fields": False}}, "discriminant": None}}, visibility="default"),
        item(23, "Dot", {"variant": {"kind": "plain", "discriminant": None}}, visibility="default"),
        item(24, "0", {"struct_field": PRIM("f64")}, visibility="default"),
        item(25, "w", {"struct_field": PRIM("f64")}, visibility="default"),
        item(26, "h", {"struct_field": PRIM("f64")}, visibility="default"),
        item(30, "Draw", {"trait": {"is_auto": False, "is_unsafe": False, "is_dyn_compatible": True, "items": [32, 33], "generics": _generics(), "bounds": [trait("Sized")], "implementations": []}}, "Draws."),
        item(31, "gated", function([], None, is_unsafe=True, abi={"C": {"unwind": False}}), attrs=['#[cfg(feature = "extra")]']),
        item(32, "draw", function([["self", SELF_REF]], None, body=False), "Must.", visibility="default"),
        item(33, "clear", function([["self", SELF_REF]]), "May.", visibility="default"),
        item(40, None, use("containers::Stack", "Pile", 3)),
        item(41, None, use("other::Thing", "Thing", 700)),
        item(42, None, use("other", "other", 701, True)),
        item(50, "prelude", module([51])),
        item(51, None, use("crate::containers", "containers", 1, True)),
        item(60, "hidden", function([]), visibility="crate"),
    ]
    paths = {"0": (["shop"], "module"), "1": (["shop", "containers"], "module"), "2": (["shop", "add"], "function"), "3": (["shop", "containers", "Stack"], "struct"), "9": (["shop", "containers", "LIMIT"], "constant"), "20": (["shop", "Shape"], "enum"), "30": (["shop", "Draw"], "trait"), "31": (["shop", "gated"], "function"), "50": (["shop", "prelude"], "module"), "700": (["other", "Thing"], "struct"), "701": (["other"], "module")}
    return json.dumps({"root": 0, "crate_version": "1.0.0", "includes_private": False, "format_version": 57, "index": {str(r["id"]): r for r in rows}, "paths": {k: {"crate_id": 0, "path": p, "kind": kind} for k, (p, kind) in paths.items()}, "external_crates": {}})
