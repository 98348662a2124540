"""Tables of a documentation index, and the fixed dimension of symbol kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEMS = """package string, item_id long, path string, name string, kind string, signature string, docs string, summary string,
span struct<file:string,line_start:int,line_end:int>, is_public boolean, has_body boolean, feature_gate string, reexport_source string"""
CHILDREN = "package string, parent_id long, pos int, child_id long"
TRAIT_IMPLS = "package string, item_id long, pos int, trait_path string, is_synthetic boolean"
GLOB_USES = "package string, parent_path string, source_path string"
FORMAT_VERSION = 4

# Kind, short name, category rank, primary, filter group.
KINDS = [
    ("Module", "mod", 0, False, "Module"),
    ("Struct", "struct", 1, True, "Struct"),
    ("Enum", "enum", 2, True, "Enum"),
    ("Union", "union", 3, True, "Union"),
    ("Trait", "trait", 4, True, "Trait"),
    ("TraitAlias", "trait alias", 4, True, "Trait"),
    ("Function", "fn", 5, False, "Function"),
    ("TypeAlias", "type", 6, True, "TypeAlias"),
    ("AssocType", "type", 6, False, "TypeAlias"),
    ("ForeignType", "type", 6, False, "TypeAlias"),
    ("Constant", "const", 7, False, "Constant"),
    ("AssocConst", "const", 7, False, "Constant"),
    ("Static", "static", 8, False, "Static"),
    ("Macro", "macro", 9, False, "Macro"),
    ("ProcMacro", "proc macro", 9, False, "Macro"),
    ("Variant", "variant", 10, False, "Variant"),
    ("Field", "field", 11, False, "Field"),
    ("Primitive", "primitive", 12, False, "Primitive"),
]
# Headers of the categories by rank.
HEADERS = ["modules:", "structs:", "enums:", "unions:", "traits:", "functions:", "type aliases:", "constants:", "statics:", "macros:", "variants:", "fields:", "primitives:"]
# What the kind option accepts.
KIND_OPTIONS = {"fn": "Function", "struct": "Struct", "enum": "Enum", "trait": "Trait", "type": "TypeAlias", "const": "Constant", "mod": "Module", "macro": "Macro"}


def _lookup(at: int):
    def of(kind: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for row in KINDS for x in (row[0], row[at])]), kind)

    return of


short_name, category, is_primary, filter_group = (_lookup(i) for i in (1, 2, 3, 4))


def header(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(h) for h in HEADERS]), rank + 1)


def shows_signature(rank: Column) -> Column:
    """Functions, type aliases, constants and statics are listed with their signature."""
    return rank.between(5, 8)


def kind_option(value: str | None) -> str | None:
    if value is None:
        return None
    if value.lower() not in KIND_OPTIONS:
        raise ValueError(f"unknown kind {value!r}: one of {', '.join(KIND_OPTIONS)}")
    return KIND_OPTIONS[value.lower()]
