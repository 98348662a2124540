import random

from symloom.llm import decontaminate as d
from symloom.llm import queries


def distance(pattern, text):
    """Smallest edit distance to a run of text, and where it first ends, by the full table."""
    row, best = list(range(len(pattern) + 1)), None
    for end, w in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != w)))
        row = new
        if best is None or row[-1] < best[0]:
            best = (row[-1], end)
    return best


def brute(docs, items):
    out = set()
    for doc_id, text in docs:
        words = d.words_of((text or "").encode())
        for item_id, item in items:
            pattern = d.words_of((item or "").encode())
            if pattern and words:
                k, end = distance(pattern, words)
                if k <= d.budget(len(pattern)):
                    out.add((doc_id, item_id, k, end, len(pattern)))
    return out


def test_against_full_table(spark):
    pick = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(pick.choice(vocabulary) for _ in range(pick.choice([1, 3, 5, 12, 38, 70])))) for i in range(25)] + [(90, None), (91, " \n"), (None, "lone item of five words")]
    docs = [(1000, None), (1001, ""), (1002, "Lone, item of FIVE words!")]
    for i in range(80):
        text = [pick.choice(vocabulary) for _ in range(pick.choice([0, 5, 90, 300]))]
        if i % 2:
            passage = pick.choice(items[:25])[1].split()
            for _ in range(pick.choice([0, 1, 2, 5, 9, 14])):
                at = pick.randrange(len(passage) + 1)
                passage[at : at + pick.choice([0, 1])] = [pick.choice(vocabulary)] * pick.choice([0, 1])
            at = pick.randrange(len(text) + 1)
            text[at:at] = [w.upper() + "," for w in passage]
        docs.append((i, " ".join(text)))
    got = d.matches(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=100)
    assert {tuple(r) for r in got.collect()} == brute(docs, items)


def test_query_against_full_table(spark, sf_tiny):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_tiny}/benchmark.parquet").collect()]
    docs = [x for x in docs if len(x[1]) < 3000]
    got = {tuple(r) for r in queries.op2_decontaminate(spark, sf_tiny).collect()}
    assert {x for x in got if x[0] in {i for i, _ in docs}} == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string, distance int"), spark.createDataFrame([], "item_id long, text string")
    assert d.matches(spark, docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert d.matches(spark, some, items).count() == 0 and d.clean(spark, some, items).count() == 1
