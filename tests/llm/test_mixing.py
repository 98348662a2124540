import duckdb
import pytest

from symloom.llm import mixing, queries

SCHEMA = "doc_id long, source string, text string"


def targets(sizes):
    """Target of each source (name -> words) by resharing until none is above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: n % 3 + 1 for n, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return {s: 3.0 * sizes[s] for s in names}
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        new = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= new


def check(rows, got, near=True):
    sizes, most = {}, {}
    for _, source, text in rows:
        n = len((text or "").split())
        sizes[source] = sizes.get(source, 0) + n
        most[source] = max(most.get(source, 0), n)
    want = targets(sizes)
    assert len(got) == len(rows)
    for source, size in sizes.items():
        own = [r for r in got if r["source"] == source]
        assert all(r["source_size"] == size and r["target"] == pytest.approx(want[source]) for r in own)
        assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in own)
        assert not near or abs(sum(r["taken"] for r in own) - want[source]) <= most[source] / 2 + 1e-6


def test_targets_and_sums(spark):
    rows = [(i, ["a", "b", "c", "d", None][i % 5] if i % 7 else "a", "w " * (i * 37 % 90)) for i in range(400)]
    rows += [(1000 + i, "tiny", "one two three") for i in range(2)] + [(2000, "huge", "x " * 30000), (2001, "huge", "y"), (2002, "empty", None), (2003, "empty", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.mix(spark, df).collect()
    check(rows, got, near=False)
    for source in ("a", "b", "c", "d", None, "tiny"):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(spark, df.repartition(5)).collect()))


def test_inclusion_rates(spark):
    """Many sources of the same documents: each is taken as often as its probability says, and larger ones more often."""
    sizes, many = [5, 8, 10, 12, 15, 20, 25, 30, 40, 50, 60, 70, 80, 90, 100, 120] * 3, 300
    rows = [(k * 1000 + n, f"s{k:04d}", "w " * size) for k in range(many) for n, size in enumerate(sizes)]
    got = mixing.mix(spark, spark.createDataFrame(rows, SCHEMA)).filter("source_size * 0.4 < target AND target < source_size * 0.6").collect()
    assert len({r["source"] for r in got}) == many // 3
    for size in sorted(set(sizes)):
        own = [r for r in got if r["size"] == size]
        rate = sum(r["copies"] for r in own) / len(own)
        assert abs(rate - own[0]["probability"]) < 0.12, (size, rate, own[0]["probability"])
    chance = {r["size"]: r["probability"] for r in got}
    assert chance[120] > 2 * chance[50] > 4 * chance[12] * 0.9
    assert sum(chance[s] * s for s in sizes) == pytest.approx(got[0]["target"])


def test_certain_documents(spark):
    """A document whose share of the squares would give it a probability above one is certain."""
    rows = [(n, "a", "w " * 10) for n in range(100)] + [(500, "a", "w " * 400)] + [(600 + n, "b", "x " * 10) for n in range(40)]
    got = mixing.mix(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    check(rows, got)
    big = next(r for r in got if r["doc_id"] == 500)
    assert big["probability"] == 1.0 and big["copies"] == 1


def test_nulls_ties_repeats_empty_and_other_columns(spark):
    assert mixing.mix(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a", f"word {i} " * (i % 4)) for i in range(40)] + [(7, "a", "same words here")] * 4 + [(i, "b", "tie tie") for i in range(30)] + [(None, None, None)]
    got = mixing.mix(spark, spark.createDataFrame([(*r, 1, "z", 2) for r in rows], SCHEMA + ", size int, sid string, owed int")).collect()
    check(rows, got, near=False)
    assert len({r["copies"] for r in got if r["doc_id"] == 7 and r["source"] == "a"}) == 1
    none = [r for r in got if r["doc_id"] is None and r["source"] == "a"]
    assert abs(sum(r["taken"] for r in got if r["source"] == "a") - none[0]["target"]) <= 12
    assert len({r["copies"] for r in none if r["size"]}) > 1  # rows without id draw each for its own text


def test_query_against_sql(spark, sf_tiny):
    got = queries.op3_mix_sources(spark, sf_tiny).collect()
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").collect()
    check([(r["doc_id"], r["source"], r["text"]) for r in docs], got)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_tiny}/documents.parquet'")
    want = {r[0]: r[1:] for r in db.execute(queries.OP3_SQL).fetchall()}
    assert {r["doc_id"]: (r["source"], r["size"], r["source_size"]) for r in got} == {k: v[:3] for k, v in want.items()}
    assert all(r["target"] == pytest.approx(want[r["doc_id"]][3]) for r in got)
