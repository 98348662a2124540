"""One-line signatures of documented items, printed from their JSON syntax trees.

Trees nest without bound, so this is a vectorised UDF over (item, its fields in order); the fields are
joined to the item before it runs. Every printer takes a node and returns text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _tag(node) -> tuple[str, object]:
    """An enum value: its tag and content; a bare string has none."""
    return (node, None) if isinstance(node, str) else next(iter(node.items()))


def _public(item: dict) -> str:
    return "pub " if item.get("visibility") == "public" else ""


def _many(nodes, one, by: str) -> str:
    return by.join(one(n) for n in nodes)


def higher_ranked(params) -> str:
    return f"for<{_many(params, param, ', ')}> " if params else ""


def bound(node) -> str:
    tag, body = _tag(node)
    if tag == "trait_bound":
        mark = {"maybe": "?", "maybe_const": "~const "}.get(body.get("modifier"), "")
        return higher_ranked(body.get("generic_params")) + mark + path(body["trait"])
    if tag == "use":
        return f"use<{_many(body, lambda a: a if isinstance(a, str) else _tag(a)[1], ', ')}>"
    return body


def bounds(nodes, lead: str = ": ") -> str:
    return lead + _many(nodes, bound, " + ") if nodes else ""


def param(node) -> str:
    tag, body = _tag(node["kind"])
    if tag == "lifetime":
        return node["name"] + (": " + " + ".join(body["outlives"]) if body["outlives"] else "")
    if tag == "const":
        default = body.get("default")
        return f"const {node['name']}: {type_(body['type'])}" + ("" if default is None else f" = {default}")
    default = body.get("default")
    return node["name"] + bounds(body["bounds"]) + ("" if default is None else f" = {type_(default)}")


def generics(node) -> str:
    """The parameters a reader wrote: those the compiler made for ``impl Trait`` are left out."""
    shown = [p for p in node["params"] if not (_tag(p["kind"])[0] == "type" and _tag(p["kind"])[1].get("is_synthetic"))]
    return f"<{_many(shown, param, ', ')}>" if shown else ""


def predicate(node) -> str:
    tag, body = _tag(node)
    if tag == "bound_predicate":
        return higher_ranked(body.get("generic_params")) + type_(body["type"]) + ": " + _many(body["bounds"], bound, " + ")
    if tag == "lifetime_predicate":
        return body["lifetime"] + (": " + " + ".join(body["outlives"]) if body["outlives"] else "")
    return f"{type_(body['lhs'])} = {term(body['rhs'])}"


def where(node) -> str:
    found = node.get("where_predicates")
    return " where " + _many(found, predicate, ", ") if found else ""


def term(node) -> str:
    tag, body = _tag(node)
    return type_(body) if tag == "type" else body["expr"]


def argument(node) -> str:
    tag, body = _tag(node)
    return {"lifetime": lambda: body, "type": lambda: type_(body), "const": lambda: body["expr"], "infer": lambda: "_"}[tag]()


def constraint(node) -> str:
    tag, body = _tag(node["binding"])
    return node["name"] + arguments(node.get("args")) + (f" = {term(body)}" if tag == "equality" else ": " + _many(body, bound, " + "))


def arguments(node) -> str:
    if node is None:
        return ""
    tag, body = _tag(node)
    if tag == "return_type_notation":
        return "(..)"
    if tag == "parenthesized":
        out = body.get("output")
        return f"({_many(body['inputs'], type_, ', ')})" + ("" if out is None else f" -> {type_(out)}")
    inside = [argument(a) for a in body["args"]] + [constraint(c) for c in body["constraints"]]
    return f"<{', '.join(inside)}>" if inside else ""


def path(node) -> str:
    return node["path"] + arguments(node.get("args"))


def abi(node) -> str:
    tag, body = _tag(node)
    if tag == "Rust":
        return ""
    if tag == "Other":
        return f'extern "{body}" '
    unwind = "-unwind" if isinstance(body, dict) and body.get("unwind") else ""
    return f'extern "{tag if tag == "C" else tag.lower()}{unwind}" '


def qualifiers(header) -> str:
    return "".join(word + " " for word in ("const", "async", "unsafe") if header.get(f"is_{word}")) + abi(header.get("abi", "Rust"))


def returned(sig) -> str:
    out = "()" if sig.get("output") is None else type_(sig["output"])
    return "" if out == "()" else f" -> {out}"


def inputs(sig, one) -> str:
    return "(" + ", ".join([one(n, t) for n, t in sig["inputs"]] + ["..."] * bool(sig.get("is_c_variadic"))) + ")"


def reference(body, to: str) -> str:
    life = body.get("lifetime")
    return "&" + (f"{life} " if life else "") + ("mut " if body.get("is_mutable") else "") + to


def receiver(name: str, node) -> str:
    """``self`` in its short forms; any other parameter as ``name: type``."""
    own = {"generic": "Self"}
    if name == "self" and node == own:
        return "self"
    if name == "self" and _tag(node)[0] == "borrowed_ref" and _tag(node)[1]["type"] == own:
        return reference(_tag(node)[1], "self")
    return f"{name}: {type_(node)}"


def qualified(body) -> str:
    trait, own = body.get("trait"), type_(body["self_type"])
    return (f"<{own} as {path(trait)}>" if trait else own) + "::" + body["name"] + arguments(body.get("args"))


_TYPES = {
    "resolved_path": path,
    "generic": str,
    "primitive": str,
    "borrowed_ref": lambda b: reference(b, type_(b["type"])),
    "raw_pointer": lambda b: ("*mut " if b.get("is_mutable") else "*const ") + type_(b["type"]),
    "tuple": lambda b: f"({_many(b, type_, ', ')})",
    "slice": lambda b: f"[{type_(b)}]",
    "array": lambda b: f"[{type_(b['type'])}; {b['len']}]",
    "impl_trait": lambda b: "impl " + _many(b, bound, " + "),
    "dyn_trait": lambda b: "dyn " + " + ".join([higher_ranked(t.get("generic_params")) + path(t["trait"]) for t in b["traits"]] + [b["lifetime"]] * bool(b.get("lifetime"))),
    "function_pointer": lambda b: higher_ranked(b.get("generic_params")) + qualifiers(b["header"]) + "fn" + inputs(b["sig"], lambda _, t: type_(t)) + returned(b["sig"]),
    "qualified_path": qualified,
    "infer": lambda _: "_",
    "pat": lambda b: type_(b["type"]),
}


def type_(node) -> str:
    tag, body = _tag(node)
    return _TYPES[tag](body)


def _field_type(field: dict | None) -> str | None:
    return type_(field["inner"]["struct_field"]) if field and "struct_field" in field.get("inner", {}) else None


def _named(fields: list, lead) -> list[str]:
    return [f"{lead(f)}{f.get('name') or '_'}: {_field_type(f)}" for f in fields if _field_type(f) is not None]


def _struct(head, name, b, fields) -> str:
    tag, body = _tag(b["kind"])
    shape = ""
    if tag == "tuple":
        shape = "(" + ", ".join("_" if _field_type(f) is None else _public(f) + _field_type(f) for f in fields) + ")"
    elif tag == "plain":
        shown = _named([f for f in fields if f and _public(f)], _public)
        if shown:
            shape = " { " + ", ".join(shown) + (", /* private fields */" if body.get("has_stripped_fields") else "") + " }"
    return f"{head}struct {name}{generics(b['generics'])}{shape}{where(b['generics'])}"


def _union(head, name, b, fields) -> str:
    shown = _named([f for f in fields if f], _public)
    return f"{head}union {name}{generics(b['generics'])}" + (" { " + ", ".join(shown) + " }" if shown else "") + where(b["generics"])


def _variant(_, name, b, fields) -> str:
    tag, _body = _tag(b["kind"])
    if tag == "tuple":
        return f"{name}({', '.join(_field_type(f) or '_' for f in fields)})"
    return name if tag == "plain" else f"{name} {{ {', '.join(_named([f for f in fields if f], lambda _f: ''))} }}"


def _trait(head, name, b, _) -> str:
    words = "unsafe " * bool(b.get("is_unsafe")) + "auto " * bool(b.get("is_auto"))
    return f"{head}{words}trait {name}{generics(b['generics'])}{bounds(b['bounds'])}{where(b['generics'])}"


def _assoc_type(_, name, b, __) -> str:
    given = b.get("type")
    return f"type {name}{generics(b['generics'])}{bounds(b['bounds'])}" + ("" if given is None else f" = {type_(given)}") + where(b["generics"])


_ITEMS = {
    "struct": _struct,
    "union": _union,
    "variant": _variant,
    "trait": _trait,
    "assoc_type": _assoc_type,
    "enum": lambda v, n, b, _: f"{v}enum {n}{generics(b['generics'])}{where(b['generics'])}",
    "trait_alias": lambda v, n, b, _: f"{v}trait {n}{generics(b['generics'])}{bounds(b['params'], ' = ')}{where(b['generics'])}",
    "function": lambda v, n, b, _: f"{v}{qualifiers(b['header'])}fn {n}{generics(b['generics'])}{inputs(b['sig'], receiver)}{returned(b['sig'])}{where(b['generics'])}",
    "type_alias": lambda v, n, b, _: f"{v}type {n}{generics(b['generics'])} = {type_(b['type'])}{where(b['generics'])}",
    "constant": lambda v, n, b, _: f"{v}const {n}: {type_(b['type'])}",
    "assoc_const": lambda v, n, b, _: f"const {n}: {type_(b['type'])}",
    "static": lambda v, n, b, _: f"{v}static {'mut ' if b.get('is_mutable') else ''}{n}: {type_(b['type'])}",
    "macro": lambda v, n, b, _: f"macro_rules! {n}",
    "proc_macro": lambda v, n, b, _: {"bang": "#[proc_macro]", "attr": "#[proc_macro_attribute]", "derive": "#[proc_macro_derive]"}[b["kind"]] + f" {n}",
    "module": lambda v, n, b, _: f"{v}mod {n}",
    "struct_field": lambda v, n, b, _: f"{v}{n}: {type_(b)}",
    "primitive": lambda v, n, b, _: f"{v}primitive {n}",
}


def signature(item: str, fields) -> str | None:
    """None for items without a signature (impl, use, extern crate, extern type)."""
    node = json.loads(item)
    tag, body = _tag(node["inner"])
    if tag not in _ITEMS:
        return None
    return _ITEMS[tag](_public(node), node.get("name") or "", body, [None if f is None else json.loads(f) for f in (() if fields is None else fields)])


@F.pandas_udf(StringType())
def _signature(items: pd.Series, fields: pd.Series) -> pd.Series:
    return pd.Series([signature(i, f) for i, f in zip(items, fields, strict=True)], dtype=object)


def render_signature(item: Column, fields: Column) -> Column:
    return _signature(item, fields)
