import hashlib
import re

import pytest

from symloom.llm import pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(value):
    d = [int(c) for c in re.sub("[^0-9]", "", value)][::-1]
    return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    spans = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            v = m[0]
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: luhn(v), "phone": lambda: 10 <= len(re.sub("[^0-9]", "", v)) <= 15}[kind]()
            if ok:
                spans.append((m.start(), n, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)]


HARD = [
    None, "", "a@b.c_d@e.f", "a@b.c.d@e.f", "x.@y-.z..", "1.2.3.4.5.6.7.8", "300.1.2.3 1.2.3.256", "01.002.3.4", "12.34.56.78.", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (375) 555-4393 +49+12 345 678 901", "++1234567890", "é😀 mail: é.x@mail.example.com 4111111111111111é", "a" * 3000 + "@" + "b" * 3000 + ".c" * 500, "1 " * 4000, "9" * 30000, "1.2." * 500,
    "+" * 50 + "1" * 12, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "1.2.3.x4.5.6.7", "call me (212) 555-0188 or write joe (at) example (dot) com", "\n+1 2\n3456789012",
]


def test_base_spans_match_the_patterns(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.detect(docs).select("doc_id", pii.label(pii.F.col("base")).alias("s")).collect()}
    for i, t in enumerate(HARD):
        assert got[i] == ",".join(brute(t)), t[:60]


def test_query_keeps_base_spans_and_digest(spark, sf_tiny):
    rows = queries.op6_pii_spans(spark, sf_tiny).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(","))
        assert r["n_email"] == sum(x.startswith("email") for x in want)


def test_em_learns_which_labelers_to_trust():
    cases = [(3, (0, 1, 0, 1, 1), 1, 80), (3, (0, 0, 0, 1, 1), 1, 40), (3, (0, 0, -1, -1, -1), 1, 90), (3, (0, 1, 0, -1, 1), 1, 10)]
    posterior, table = pii.reliabilities(cases)
    assert posterior[0] > 0.9 > 0.1 > posterior[2]
    assert table[3, 1, 1] > table[3, 1, 0]
    weights = pii.logistic([(pii.features(k, v, s), n, p) for (k, v, s, n), p in zip(cases, posterior, strict=True)])
    assert len(weights) == pii._width()


@pytest.mark.parametrize("text,want", [("", ""), ("to a@b.co now", "to <email> now"), ("1.2.3.4 x", "<ip> x")])
def test_redact(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.redact(docs).first()["text"] == want


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, base string, strict int, x string")
    assert pii.detect(docs).count() == 0
    docs = spark.createDataFrame([(None, "a@b.c", "z", 1), (1, "a@b.c", None, None), (1, "a@b.c", None, None)], "doc_id long, text string, base string, kind int")
    assert [len(r["base"]) for r in pii.detect(docs).collect()] == [1, 1, 1]


SPELT = ["write jane (at) example.com", "write jane[at]example.com", "jane at example.com", "jane(at)example dot com", "jane (at) example (dot) com", "jane\n(at) example.com", "nothing at all", "8 at 10.30"]


def test_loose_candidates_do_not_hang_on_other_text(spark):
    rows = [(2 * i + j, t + rest) for i, t in enumerate(SPELT) for j, rest in enumerate(("", " | @"))]
    found = {r["doc_id"]: [(x["start"], x["end"]) for x in r["loose"] if x["kind"] == 0] for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(SPELT):
        want = [m.span() for m in re.finditer(pii.LOOSE["email"], t)]
        assert found[2 * i] == found[2 * i + 1] == want, t
    assert found[0] and found[2] and found[4] and found[6]


def test_every_loose_match_passes_its_gate():
    texts = {"email": SPELT, "ip": ["a:b:c:d:e:f:0:1", "1:2:3:4:5:6:7:8"], "card": ["4111.1111.1111.1111"], "phone": ["(212) 555-0188", "212 555 0188"]}
    for kind, some in texts.items():
        for t in some:
            assert not re.search(pii.LOOSE[kind], t) or re.search(pii.LOOSE_NEEDS[kind], re.search(pii.LOOSE[kind], t)[0]), t


def test_many_matches_in_one_text(spark):
    """Offsets hold over blocks, and time grows with the number of matches, not with its square."""
    import time

    def took(n):
        text = "".join(f"é{i} a{i}@b.org 10.0.{i % 300}.7, " for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        got = pii.detect(docs).select(pii.label(pii.F.col("base")).alias("s")).first()["s"]
        assert got == ",".join(brute(text))
        return time.time() - began

    for n in (0, 128, 257):
        took(n)
    small, large = took(300), took(2400)
    assert large < 8 * 3 * max(small, 0.5)


def test_added_spans_by_hand(spark):
    """What the method adds to the base: spelt-out and unusual forms beside cue words, not numbers that cue words speak against."""
    rows = [(1, "please contact jane (at) example.org today"), (2, "call me: (212) 555-0188 now"), (3, "my card 4111.1111.1111.1111 is new"), (4, "nothing here"), (5, "build version 212 555 0188abc")] * 1
    rows += [(100 + i, f"phone: (212) 555-{1000 + i} and email: user{i} at mail.example.com") for i in range(60)]
    got = {r["doc_id"]: r["s"] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.label(pii.F.col("added")).alias("s")).collect()}
    assert got[1] == "email:15:36" and got[2] == "phone:9:23" and got[3] == "card:8:27" and got[4] == ""
    assert all(got[100 + i].startswith("phone:7:21,email:33:") for i in range(60))
