import re
from collections import defaultdict

from symloom.llm import linededup, queries


def keys(line):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", line)
    tokens = ["<*>" if re.search("[0-9]", t) else t for t in tokens]
    if not tokens:
        return []
    head, rest = (len(tokens), *tokens[:2]), tokens[2:]
    out = [(head, None, tuple(rest))]
    if len(rest) >= 4:
        for i in range(4):
            a, b = len(rest) * i // 4, len(rest) * (i + 1) // 4
            out.append((head, i, tuple(rest[:a] + ["<*>"] + rest[b:])))
    return out


def brute(rows):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            for k in keys(line):
                held[k].add((i, t))
    gone = {k: min(i for i, _ in v) for k, v in held.items() if len(v) >= 3 and len({t for _, t in v}) > 1}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if not any(k in gone and gone[k] != i for k in keys(x))) for i, t in rows}


ROWS = [
    (1, "unique words of the first one\nuser 17 logged in from the far host\n\nshared line here"),
    (2, "user 99 logged in from the far host\nanother text that nobody else holds\nshared line here"),
    (3, "user x8 logged in from the near host\nshared line here\nshared line here"),
    (4, None), (5, ""), (6, "copy a b c d e\ncopy f g"), (7, "copy a b c d e\ncopy f g"), (8, "copy a b c d e\ncopy f g"), (9, "a b c"),
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, _lines string, c0 int")
    got = linededup.drop_lines(spark, docs)
    assert got.columns == ["doc_id", "text", "_lines", "c0", "_dropped", "_total"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute(ROWS)


def test_query_against_brute_force(spark, sf_tiny):
    import hashlib

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").collect()]
    want = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in brute(docs).items()}
    rows = queries.op8_line_dedup(spark, sf_tiny).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in rows} == want
    assert sum(r["n_dropped"] for r in rows) > 0


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert linededup.drop_lines(spark, spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, "the same line"), (1, "the same line"), (2, "the same line\nb"), (2, "the same line\nb")], schema)
    assert sorted((str(r["doc_id"]), r["text"]) for r in linededup.drop_lines(spark, docs).collect()) == [("1", "the same line"), ("2", "b"), ("2", "b"), ("None", "")]


def test_repeated_rows_are_one_document(spark):
    line = "one line that several documents hold"
    for rows in ([(1, line), (2, line + "\nb")], [(1, line), (2, line + "\nb"), (2, line + "\nb")], [(1, line)] * 3 + [(2, line + "\nb")] * 4, [(1, line), (2, line + "\nb"), (2, line + "\nc")]):
        got = {(r["doc_id"], r["text"]) for r in linededup.drop_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        want = brute_rows(rows)
        assert got == want


def brute_rows(rows):
    held = defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            for k in keys(x):
                held[k].add((i, t))
    gone = {k: min(i for i, _ in v) for k, v in held.items() if len(v) >= 3 and len({t for _, t in v}) > 1}
    return {(i, "\n".join(x for x in t.split("\n") if not any(k in gone and gone[k] != i for k in keys(x)))) for i, t in rows}
