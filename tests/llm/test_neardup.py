import random
import re

from symloom.llm import neardup, queries


def bag(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width):
    bags = [(i, bag(t, width)) for i, t in rows]
    up = {i: i for i, _ in bags}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, x) in enumerate(bags):
        for j, y in bags[:n]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(x), root(i), i == root(i)) for i, x in bags}


def check(spark, rows, width):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.classes(spark, docs, width).collect()}
    assert got == brute(rows, width)


def test_against_all_pairs(spark):
    pick = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(1000, None), (1001, ""), (1002, "One"), (1003, "one"), (1004, "one two"), (1005, " \t\n")]
    for g in range(12):
        base = [pick.choice(vocabulary) for _ in range(pick.choice([12, 60, 150]))]
        for _ in range(pick.choice([1, 2, 9, 25])):
            edited = list(base)
            for _ in range(pick.choice([0, 1, 2, 6, 9])):
                edited[pick.randrange(len(edited))] = pick.choice(vocabulary)
            rows.append((len(rows), " ".join(edited).upper() if pick.random() < 0.3 else " ".join(edited)))
    check(spark, rows, 2)


def test_query_against_all_pairs(spark, sf_tiny):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op1_minhash_near_dedup(spark, sf_tiny).collect()}
    assert got == brute(docs, 2)


def test_empty_nulls_and_repeats(spark):
    assert neardup.classes(spark, spark.createDataFrame([], "doc_id long, text string, n int, comp int")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None)], "doc_id long, text string")
    got = sorted(tuple(str(x) for x in r) for r in neardup.classes(spark, docs).collect())
    assert got == [("5", "2", "5", "True"), ("5", "2", "5", "True"), ("7", "0", "7", "True"), ("None", "2", "5", "False")]


def test_pruning_bounds_follow_the_posterior():
    need = neardup.least_matches(80)
    assert list(need) == [16, 32, 48, 64]
    assert all(0 < need[n] < 0.8 * n for n in need)


def test_large_groups_with_few_links(spark):
    """Near copies of one text, most of them too far apart to link, and a family among them that differs from it in one way."""
    pick = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [pick.choice(vocabulary) for _ in range(120)]
    other = base[:80] + [pick.choice(vocabulary) for _ in range(40)]
    rows = []
    for n in range(260):
        edited = list(other if n % 4 == 0 else base)
        for _ in range(pick.choice([0, 1, 3, 5, 6, 7, 8, 9, 12, 16])):
            edited[pick.randrange(len(edited))] = pick.choice(vocabulary)
        rows.append((1000 - n, " ".join(edited)))
    for width in (2, 5):
        check(spark, rows, width)


def test_shared_ids_and_null_ids_keep_their_texts_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(9, a), (9, b), (3, a + " x"), (4, b + " x"), (None, a + " y"), (None, b + " y"), (None, "z z z"), (9, None)]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in neardup.classes(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == sorted([("9", 39, "3", False), ("9", 39, "3", False), ("3", 40, "3", True), ("4", 40, "3", False), ("None", 40, "3", False), ("None", 40, "3", False), ("None", 1, "None", True), ("9", 0, "9", True)])
    del rows[:2]  # without the shared id nothing joins the two
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.classes(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {(3, 40, 3), (4, 40, 4), (None, 40, 3), (None, 40, 4), (None, 1, None), (9, 0, 9)}
