"""Scalar text functions as Column expressions. Byte budgets count UTF-8 bytes and never cut a character."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = r"\p{IsUppercase}"
SENTENCE = r"(?s)(?U)^.*?(?:\.(?=\s+\p{IsUppercase}|\s*\z)|[!?](?=\s|\z))"
# Words that name methods.
METHOD_WORDS = ["clone", "default", "into", "from", "borrow", "deref", "format", "parse", "write", "read", "open", "close", "send", "recv"]
# Build output that speaks of the platform, and pairs that do so together.
FAILURES = [
    "failed to run custom build command",
    "could not find",
    "ld: library not found",
    "ld: framework not found",
    "ld: cannot find",
    "Unable to find",
    "not found in PATH",
    "LINK : fatal error",
    "error occurred: Command",
    "is not recognized as an internal or external command",
    "cannot specify features for packages outside of workspace",
]
FAILURE_PAIRS = [("linker", "error"), ("could not find", "native")]


def utf8_prefix(text: Column, size: int) -> Column:
    """The longest prefix of whole characters in at most ``size`` bytes."""
    raw = F.encode(text, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, max(0, size - k)).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= size, text).otherwise(F.coalesce(*cuts))


def summary(text: Column, size: int = 100) -> Column:
    """The first sentence, else the first line within ``size`` bytes."""
    sentence = F.regexp_extract(text, SENTENCE, 0)
    line = F.substring_index(text, "\n", 1)
    short = F.when(F.octet_length(line) <= size, line).otherwise(F.concat(utf8_prefix(line, size), F.lit("...")))
    return F.when(sentence != "", sentence).otherwise(short)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def truncate(text: Column, size: int = 1500) -> Column:
    """Cut to ``size`` bytes at a paragraph, sentence, word or character, in that order of preference."""
    head = utf8_prefix(text, size)
    paragraph = F.nullif(F.regexp_extract(head, r"(?s)\A(.*)\n\n", 1), F.lit(""))
    sentence = F.nullif(F.regexp_extract(head, r"(?s)\A(.*[.!?]) ", 1), F.lit(""))
    word = F.nullif(F.regexp_extract(head, r"(?s)\A(.*) ", 1), F.lit(""))
    dots = F.lit("...")
    cut = F.coalesce(F.concat(_trimmed(paragraph), dots), sentence, F.concat(_trimmed(word), dots), F.concat(head, dots))
    return F.when(F.octet_length(text) <= size, text).otherwise(cut)


def first_paragraph(text: Column, sentences: int = 3, size: int = 200) -> Column:
    """Up to a blank line; else some sentences; else a line or words within ``size`` bytes."""
    some = F.nullif(F.regexp_extract(text, rf"(?s)\A((?:.*?[.!?](?= )){{{sentences}}})", 1), F.lit(""))
    whole = F.when(F.right(text, F.lit(1)).isin(".", "!", "?"), text)
    line = F.substring_index(text, "\n", 1)
    line = F.when((F.instr(text, "\n") > 0) & (F.octet_length(line) <= size), line)
    head = utf8_prefix(text, size)
    last = F.regexp_extract(head, r"(?s)\A(.*) ", 1)
    words = F.concat(F.when(F.instr(head, " ") > 0, last).otherwise(head), F.lit("..."))
    short = F.when(F.octet_length(text) <= size, text).otherwise(F.coalesce(line, words))
    return F.when(F.instr(text, "\n\n") > 0, F.substring_index(text, "\n\n", 1)).otherwise(F.coalesce(some, whole, short))


def trim_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n+\z", "")


def gate_suffix(gate: Column) -> Column:
    return F.when(gate.isNotNull(), F.concat(F.lit("  [feature: "), gate, F.lit("]"))).otherwise("")


def query_terms(query: Column) -> Column:
    """Groups of lower-case terms: ``|`` separates alternatives, blanks separate terms that must all match."""
    groups = F.transform(F.split(F.lower(query), r"\|"), lambda g: F.filter(F.split(g, r"(?U)\s+"), lambda t: t != ""))
    return F.filter(groups, lambda g: F.size(g) > 0)


def distance(left: Column, right: Column, most: int) -> Column:
    """Edit distance in characters, null beyond ``most``."""
    d = F.levenshtein(left, right, most)
    return F.when(d >= 0, d)


def may_be_near(left: Column, right: Column, most: int = 3) -> Column:
    """Lengths within ``most`` bytes of each other; beyond two bytes, a gap that large needs the same first byte."""
    gap = F.abs(F.octet_length(left) - F.octet_length(right))
    first = F.substring(F.encode(left, "UTF-8"), 1, 1) == F.substring(F.encode(right, "UTF-8"), 1, 1)
    long_ = (F.octet_length(left) > 2) & (F.octet_length(right) > 2)
    return (gap <= most) & ~(long_ & ~first & (gap >= most))


def looks_like_item(name: Column) -> Column:
    """Whether a bare name is likelier a symbol than a package."""
    parts = F.size(F.split(name, "_"))
    plain = F.replace(name, F.lit("_"), F.lit("")).rlike(r"(?U)^[\p{IsLowercase}0-9]*$")
    mean = F.floor((F.octet_length(name) - parts + 1) / parts)
    snake = ~((parts <= 3) & plain & (mean <= 6))
    return (
        F.when((name == "") | F.contains(name, F.lit("-")), False)
        .when(name.rlike(UPPER), True)
        .when(F.contains(name, F.lit("_")), snake)
        .otherwise((F.octet_length(name) <= 4) | name.isin(METHOD_WORDS))
    )


def is_platform_failure(log: Column) -> Column:
    low = F.lower(log)
    has = lambda s: F.contains(low, F.lit(s.lower()))
    return reduce(lambda a, b: a | b, [*(has(s) for s in FAILURES), *(has(a) & has(b) for a, b in FAILURE_PAIRS)])


def no_library_target(log: Column) -> Column:
    """The package that a build log says has no library."""
    return F.nullif(F.regexp_extract(log, r"no library targets found in package `([^`]*)`", 1), F.lit(""))


def reexport_source(source: Column, signature: Column) -> Column:
    """Where a re-export points: its column, else the text of its signature."""
    return F.coalesce(source, F.nullif(F.regexp_extract(signature, r"^pub use (.*?)(?: as .*|;?\s*)$", 1), F.lit("")))


def package_key(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit("_"))


def is_stdlib(name: Column) -> Column:
    return name.isin("std", "core", "alloc")


def path_gap(left: Column, right: Column) -> Column:
    """Components of two paths outside their common prefix."""
    a, b = F.filter(F.split(left, "/"), lambda x: x != ""), F.filter(F.split(right, "/"), lambda x: x != "")
    same = F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, x: F.struct((acc["n"] + (acc["go"] & x["a"].eqNullSafe(x["b"])).cast("int")).alias("n"), (acc["go"] & x["a"].eqNullSafe(x["b"])).alias("go")), lambda acc: acc["n"])
    return F.size(a) + F.size(b) - 2 * same


def djb2(text: str) -> int:
    """Hash of a configuration string, unsigned 64-bit."""
    h = 5381
    for b in text.encode():
        h = (h * 33 + b) % 2**64
    return h


def pad(text: Column, width: Column) -> Column:
    """Padded to ``width`` characters, never cut."""
    return F.rpad(text, F.greatest(width, F.char_length(text)), F.lit(" "))


def suffixes(path: Column) -> Column:
    """Every trailing run of segments, lower-case, longest first."""
    parts = F.split(path, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.lower(F.array_join(F.slice(parts, i, F.size(parts)), "::")))
