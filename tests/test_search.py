import pytest
from symbols import index

from symloom.operators import search as S


def scores(spark, rows, query, kind=None):
    return {r["path"]: r["score"] for r in S.search(index(spark, rows)[0], query, kind).collect()}


def test_tiers(spark):
    rows = [("t", "Module"), ("t::sync::Mutex", "Struct", {"docs": "A mutual exclusion primitive."}), ("t::HashMap", "Struct"), ("t::connect", "Function", {"signature": "fn connect(a: SocketAddr)"})]
    assert scores(spark, rows, "mutex") == {"t::sync::Mutex": 100}
    assert scores(spark, rows, "sync") == {"t::sync::Mutex": 30}
    assert scores(spark, rows, "map") == {"t::HashMap": 75}
    assert scores(spark, rows, "socketaddr") == {"t::connect": 40}
    assert scores(spark, rows, "primitive") == {"t::sync::Mutex": 20}
    assert scores(spark, rows, "mutex primitive") == {"t::sync::Mutex": 120}
    assert scores(spark, rows, "mutex nothing | hashmap") == {"t::HashMap": 100}
    assert scores(spark, rows, "t", "Function") == {"t::connect": 75}


def test_limit_precedes_distinct_paths(spark):
    rows = [("t", "Module")] + [("t::same", "Struct")] * 15 + [(f"t::x{i}", "Struct", {"docs": "same"}) for i in range(15)]
    got = scores(spark, rows, "same")
    assert got["t::same"] == 100 and len(got) == 6


def test_docs_window_counts_bytes(spark):
    rows = [("t::a", "Struct", {"docs": "x" * 600 + "marker"}), ("t::b", "Struct", {"docs": "é" * 246 + "marker"}), ("t::c", "Struct", {"docs": "é" * 248 + "marker"})]
    assert set(scores(spark, rows, "marker")) == {"t::b"}


@pytest.mark.parametrize("query", ["", "   ", " | "])
def test_empty_query(query):
    with pytest.raises(ValueError):
        S.parse(query)


def test_batch_equals_single(spark):
    items, _ = index(spark, [("t", "Module"), ("t::sync::Mutex", "Struct"), ("t::sync", "Module"), ("t::RwLock", "Struct")])
    queries = {1: "mutex | rwlock", 2: "sync", 3: "none"}
    batch = {(r["query_id"], r["path"], r["score"]) for r in S.search_batch(items, queries).collect()}
    assert batch == {(i, r["path"], r["score"]) for i, q in queries.items() for r in S.search(items, q).collect()}
