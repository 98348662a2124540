import numpy as np

from symloom.llm import mtree, queries


def brute(rows, asked, k=5):
    out = []
    live = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for qi, q in live:
        if not asked(qi):
            continue
        scores = sorted((-int(q @ x), i) for i, x in live if i != qi and len(x) == len(q))[:k]
        out += [(qi, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def run(spark, rows, asked, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in mtree.top_k(spark, df, df.filter(asked), **options).collect())


def test_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 3])).tolist()) for i in range(900)]
    rows += [(i + 900, rows[i % 7][1]) for i in range(300)] + [(5000, None), (5050, []), (5100, [None] * 8), (5150, [float("nan")] * 8), (5200, [float("inf")] * 8), (5250, [1.0, 2.0]), (5300, [1.0, 1.0]), (None, [1.0] * 8), (5350, [0.0] * 8)]
    for options in ({}, {"chunk": 100, "block": 7}):
        assert run(spark, rows, "vec_id % 50 = 0", **options) == brute(rows, lambda i: i % 50 == 0)


def test_query_against_all_pairs(spark, sf_tiny):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_tiny}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op7_top_k(spark, sf_tiny).collect())
    assert got == brute(rows, lambda i: i % 50 == 0)


def test_bounds_spare_distances():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 200
    points = (centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 4).astype(np.int64)
    tree = mtree.MTree(np.arange(8000), points)
    best: list = []
    tree.search(points[17], 17, best, 5)
    assert tree.computed < 4000


def test_few_rows(spark):
    assert run(spark, [(0, [1.0])], "true") == []
    assert run(spark, [], "true") == []
    assert run(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0])], "vec_id = 1") == [(1, 1, 0, 131072), (1, 2, 0, 131072)]


def test_large_components_and_repeated_queries(spark):
    rows = [(0, [1.0, 2.0]), (1, [5000000.0, 3.0]), (2, [20000.0, -20000.0]), (3, [0.5, 0.25]), (4, [3e9, 1.0]), (5, [-1e12, 0.0]), (6, [16384.0, 16384.0])]
    assert run(spark, rows, "vec_id IN (0, 3)") == brute(rows, lambda i: i in (0, 3))
    small = [r for r in rows if r[0] not in (4, 5)]
    assert run(spark, small, "true") == brute(small, lambda i: True)
    twice = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]
    assert run(spark, twice, "vec_id = 0") == [(0, 1, 3, 196608), (0, 2, 2, 131072), (0, 3, 1, 65536)]
    other = [*twice, (0, [-1.0, 0.0])]
    assert run(spark, other, "vec_id = 0") == sorted([(0, 1, 3, 196608), (0, 2, 2, 131072), (0, 3, 1, 65536), (0, 1, 2, 0), (0, 2, 1, -65536), (0, 3, 3, -65536)])


def test_scores_beyond_a_long_are_an_error():
    import pytest

    huge = mtree.compact(np.floor(np.array([[1e300, 1.0], [2.0, 3.0]])))
    tree = mtree.MTree(np.array([7, 8]), huge)
    best: list = []
    tree.search(np.array([0, 5]), 1, best, 2)
    assert sorted(best) == [(5, -7), (15, -8)]
    with pytest.raises(OverflowError):
        tree.search(np.array([5, 5]), 1, [], 2)
