import pytest
from pyspark.sql import functions as F

from symloom.functions import markdown
from symloom.functions import text as T
from symloom.operators import packages


def value(spark, make, *texts):
    row = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
    return row.select(make(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [("Adds two numbers together. Returns the sum.", "Adds two numbers together."), ("no terminator\nsecond", "no terminator"), ("", ""), ("a" * 200, "a" * 100 + "..."), ("Requires version 1.56.0 to compile", "Requires version 1.56.0 to compile"), ("é" * 80, "é" * 50 + "..."), ("Is it? yes", "Is it?"), ("e.g. this\n\n# Head\n\nmore. End", "e.g. this\n\n# Head\n\nmore.")])
def test_summary(spark, text, want):
    assert value(spark, T.summary, text) == want


@pytest.mark.parametrize("size,want", [(50, "First part...")[:2], (13, "First part..."), (9, "First..."), (3, "Fir...")])
def test_truncate(spark, size, want):
    text = "First part\n\nSecond part goes on without an end and on and on" if size != 3 else "Firstpartwithoutblanks"
    assert value(spark, lambda c: T.truncate(c, size), text) == want


def test_truncate_sentence_and_utf8(spark):
    assert value(spark, lambda c: T.truncate(c, 12), "One two. Three four") == "One two."
    assert value(spark, lambda c: T.truncate(c, 5), "日本語です") == "日..."


def test_first_paragraph(spark):
    cases = {"a\n\nb": "a", "A. B. C. D. E": "A. B. C.", "A. B!": "A. B!", "short words": "short words", "line\n" + "x " * 200: "line", "word " * 60: ("word " * 40)[:199].rstrip() + "...", "": ""}
    for text, want in cases.items():
        assert value(spark, T.first_paragraph, text) == want, text[:20]


def test_markdown():
    text = "# Title\n\nSome **bold _it_** and `code_x` [link](u) [ref][r] ![\n- one\n* two\n12. three\n> quote\n---\n```rust\n# hidden\nlet a = 1;\n\n#\n```\nend_of it_ *open"
    assert markdown.strip(text) == "Title\n\nSome bold it and code_x link ref ![\none\ntwo\nthree\nquote\n\n  let a = 1;\n  \nendof it *open"
    assert markdown.strip(None) is None and markdown.strip("") == "" and markdown.strip("a\r\nb\n\n") == "a\nb"


def test_markdown_column(spark):
    assert value(spark, T.trim_newlines, "a\n\n") == "a" and value(spark, markdown.strip_markdown, "**x**") == "x"


@pytest.mark.parametrize("name,want", [("", False), ("serde-json", False), ("HashMap", True), ("tokio_util", False), ("from_utf8_lossy", False), ("into_inner_value_long", True), ("new", True), ("clone", True), ("serde", False)])
def test_item_names(spark, name, want):
    assert value(spark, T.looks_like_item, name) is want


def test_small_functions(spark):
    assert value(spark, T.reexport_source, None, "pub use a::b as c") == "a::b" and value(spark, T.reexport_source, None, "pub struct X") is None
    assert value(spark, T.path_gap, "/a/b/c", "/a/d") == 3 and value(spark, T.is_platform_failure, "Linker: some ERROR") is True
    assert value(spark, lambda a, b: T.may_be_near(a, b), "abc", "xyzabc") is False
    assert T.djb2("") == 5381 and T.djb2("a") == 5381 * 33 + 97
    assert value(spark, T.query_terms, " A b | | c ") == [["a", "b"], ["c"]]


def test_versions(spark):
    versions = spark.createDataFrame([("p", v, y) for v, y in [("1.2.3", False), ("1.10.0", False), ("1.10.1-rc.2", False), ("1.10.1-rc.10", False), ("1.99.0", True), ("2.0.0-beta", False), ("2.0.0", False)]], "package string, num string, yanked boolean")
    asked = spark.createDataFrame([("p", w) for w in ("1", "1.2", "2", "3", "1.0.0", "latest")], "package string, wanted string")
    got = {r["wanted"]: r["version"] for r in packages.resolve_version(asked, versions).collect()}
    assert got == {"1": "1.10.1-rc.10", "1.2": "1.2.3", "2": "2.0.0", "3": None, "1.0.0": "1.0.0", "latest": "latest"}
