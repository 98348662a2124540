import hashlib
import random

import pytest

from symloom.llm import queries, suffixdedup
from symloom.llm.repeats import later_occurrences, maximal_repeats


def brute(rows, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept bytes)}"""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for n, g in enumerate(gone) if g and (n == 0 or not gone[n - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for i, v in brute(rows).items()}
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixdedup.digest(suffixdedup.cut_repeats(spark, docs)).collect()}
    assert got == want


@pytest.mark.parametrize("group", [512, 2])
def test_against_all_windows(spark, monkeypatch, group):
    monkeypatch.setattr(suffixdedup, "GROUP", group)
    pick = random.Random(group)
    word = lambda: "".join(pick.choice("abcdeé") for _ in range(pick.choice([1, 4, 7])))
    passages = [" ".join(word() for _ in range(n)) for n in (12, 20, 22, 25, 40, 90)]
    rows = [(900, None), (901, ""), (902, "x" * 99), (903, "x" * 100), (904, "x" * 350), (905, "ab" * 400), (906, "y" * 1000)]
    for i in range(60):
        parts = [" ".join(word() for _ in range(pick.choice([0, 3, 30, 60])))]
        for _ in range(pick.choice([0, 1, 3])):
            p = pick.choice(passages)
            a = pick.randrange(0, len(p) // 3 + 1)
            parts += [p[a : len(p) - pick.randrange(0, len(p) // 3 + 1)], " ".join(word() for _ in range(pick.choice([0, 2, 9])))]
        rows.append((i, pick.choice(["", " ", "\n"]).join(parts)))
    rows += [(2000 + i, rows[7 + 3 * i][1]) for i in range(6)]
    check(spark, rows)


def test_query_against_all_windows(spark, sf_tiny):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").collect()]
    want = {i: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for i, v in brute(docs).items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op5_suffix_dedup(spark, sf_tiny).collect()} == want


def test_blocks_of_a_long_text(spark, monkeypatch):
    from symloom.llm import anchors

    monkeypatch.setattr(anchors, "_BLOCK", 128)
    pick = random.Random(3)
    body = "".join(pick.choice("abc ") for _ in range(700))
    check(spark, [(1, body), (2, "zz" + body[60:500] + "qq"), (3, body[100:300] * 3)])


def test_maximal_repeats_by_brute_force():
    pick = random.Random(5)
    for _ in range(30):
        texts = ["".join(pick.choice("ab") for _ in range(pick.randrange(0, 30))).encode() for _ in range(4)]
        want = {}
        for t in texts:
            for a in range(len(t)):
                for b in range(a + 4, len(t) + 1):
                    want.setdefault(t[a:b], set())
        for s in want:
            want[s] = [(n, a) for n, t in enumerate(texts) for a in range(len(t)) if t.startswith(s, a)]
        full = set()
        for s, where in want.items():
            left = {texts[n][a - 1] if a else (n, -1) for n, a in where}
            right = {texts[n][a + len(s)] if a + len(s) < len(texts[n]) else (n, -2) for n, a in where}
            edge = any(isinstance(x, tuple) for x in left)
            if len(where) > 1 and (len(left) > 1 or edge) and (len(right) > 1 or any(isinstance(x, tuple) for x in right)):
                full.add((len(s), tuple(where)))
        assert {(n, tuple(w)) for n, w in maximal_repeats(texts, 4)} == full
        marked = {(n, x) for size, where in full for n, a in where[1:] for x in range(a, a + size)}
        assert {(n, x) for n, a, b in later_occurrences(texts, 4) for x in range(a, b)} == marked


def test_repeated_rows_nulls_and_clashing_ids(spark):
    pick = random.Random(8)
    a, b = "the quick brown fox " * 8, "".join(pick.choice("abcdefgh") for _ in range(300))
    docs = spark.createDataFrame([(None, b), (5, b), (5, b), (6, "short"), (7, b[:120]), (7, a)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in suffixdedup.cut_repeats(spark, docs).collect())
    assert got[:3] == [("5", 300, 0), ("5", 300, 0), ("6", 5, 0)]
    assert [x[1:] for x in got[3:5]] == [(120, 120), (160, 140)]  # rows of one id are searched each: the one repeats 5, the other itself
    assert got[-1] == ("None", 300, 300)
    assert suffixdedup.cut_repeats(spark, docs.limit(0)).count() == 0


def test_a_long_document_and_a_passage_that_most_documents_share(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "GROUP", 20)
    pick = random.Random(12)
    words = lambda n: " ".join("".join(pick.choice("abcdefgh") for _ in range(pick.choice([2, 5, 8]))) for _ in range(n))
    passage, long = words(26), words(30000)
    rows = [(5000, long), (5001, long[1000:90000] + words(50) + long[:300]), (5002, "ab" * 30000)]
    rows += [(i, words(pick.choice([0, 5, 40])) + " " + passage[: pick.choice([90, 110, 130, 200])] + pick.choice("xyz") + words(3)) for i in range(300)]
    rows += [(i + 400, rows[3 + i % 5][1]) for i in range(60)]
    check(spark, rows)


def test_rows_of_one_id_are_searched_each(spark):
    pick = random.Random(13)
    a, b = ("".join(pick.choice("abcdefgh") for _ in range(300)) for _ in range(2))
    docs = spark.createDataFrame([(None, a + "1"), (None, b + "2"), (1, "x" + a), (1, "y" + b), (2, a), (2, b)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in suffixdedup.cut_repeats(spark, docs).collect())
    assert got == [("1", 301, 0), ("1", 301, 0), ("2", 300, 300), ("2", 300, 300), ("None", 301, 300), ("None", 301, 300)]
