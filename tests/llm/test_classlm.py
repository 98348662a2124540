import math
import zlib
from collections import Counter

import numpy as np
import pytest

from symloom.llm import classlm, queries


def brute(docs):
    tokens = {i: [*(t or "").encode().lower().split(), "end"] for i, t in docs}
    train = Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            train.update(t)
    n, v = sum(train.values()), len(train)
    return {i: (zlib.crc32(str(i).encode()) % 10 == 0, len(t), sum(train[w] > 0 for w in t), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in tokens.items()}


@pytest.mark.parametrize("head", [classlm.HEAD, 300])
def test_base_and_held_out_gain(spark, sf_tiny, monkeypatch, head):
    monkeypatch.setattr(classlm, "HEAD", head)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_tiny}/documents.parquet").collect()]
    want = brute(docs)
    rows = queries.op10_class_lm(spark, sf_tiny).collect()
    assert len(rows) == len(docs)
    for r in rows:
        held, tokens, known, n, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_emissions_and_transitions_sum_to_one(spark):
    texts = ["a b a b c a b", "b a b a", "c c a b zz yy"] * 4
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model, counts, n, v, ends = classlm.train_model(classlm.Stages(spark, "t"), docs)
    assert np.allclose((10**model.transitions).sum(axis=1), 1)
    mass = np.zeros(classlm.CLASSES)
    for r in counts.collect():
        item = classlm.ITEMS - 1 if r["h"] == classlm.END else model.top.get(r["h"], classlm.TOP + r["g"])
        mass[model.of[item]] += (r["n"] + classlm.ADD) / 10 ** model.denominators[model.of[item]]
    unknown = classlm.ADD / 10**model.denominators
    assert np.allclose(mass + unknown, 1) and (n, ends) == (sum(len(t.split()) + 1 for t in texts), 12)


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(1)
    bigrams = np.zeros((21, 21))
    seq = [20] + [int(rng.integers(0, 10)) + 10 * (i % 2) for i in range(8000)] + [20]
    np.add.at(bigrams, (seq[:-1], seq[1:]), 1)
    of = classlm.exchange(bigrams, classes=3)
    assert len(set(of[:10])) == 1 and len(set(of[10:20])) == 1 and of[0] != of[10]


def test_empty_and_null(spark):
    schema = "doc_id long, text string, row int, h int"
    assert classlm.score(spark, spark.createDataFrame([], schema)).count() == 0
    got = classlm.score(spark, spark.createDataFrame([(None, None, 1, 1), (1, "A b", 1, 1), (1, "A b", 1, 1), (2, "", 1, 1)], schema)).collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in sorted(got, key=lambda r: (r["doc_id"] or 0, r["n_tokens"]))] == [(None, 1), (1, 3), (1, 3), (2, 1)]


def test_rare_words_of_one_ending_get_classes_by_exchange(spark):
    rng = np.random.default_rng(2)
    lines = [" ".join(f"{'xy'[j % 2]}{int(k)}" for j, k in enumerate(rng.integers(0, 225, 40))) for _ in range(200)]
    lines += [f"x{2 * i} y{i} qax_end y{i + 1} x{i}" for i in range(4)] + [f"y{2 * i} x{i} qbx_end x{i + 1} y{i}" for i in range(4)]
    assert classlm.group_of(b"qax_end") == classlm.group_of(b"qbx_end")
    asked = ["y1 qax_end y2", "y1 qbx_end y2", "x1 qax_end x2", "x1 qbx_end x2"]
    docs = spark.createDataFrame([*((i, t) for i, t in enumerate(lines) if zlib.crc32(str(i).encode()) % 10), *((i, t) for i, t in enumerate(lines, 1000) if zlib.crc32(str(i).encode()) % 10 and "end" in t), *((-i - 1, t) for i, t in enumerate(asked))], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in classlm.score(spark, docs).filter("doc_id < 0").collect()}
    assert got[-1] > got[-2] and got[-4] > got[-3]


def test_head_is_only_a_shortcut(spark, sf_tiny, monkeypatch):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: (r["n_known"], pytest.approx(r["score"], rel=1e-9)) for r in classlm.score(spark, docs).collect()}
    monkeypatch.setattr(classlm, "HEAD", 1000)
    assert {r["doc_id"]: (r["n_known"], r["score"]) for r in classlm.score(spark, docs).collect()} == want


def test_best_classes_grow_the_likelihood():
    rng = np.random.default_rng(3)
    bigrams = rng.integers(0, 5, (31, 31)).astype(float)
    of = np.append(rng.integers(0, 4, 30), 4)
    member = np.eye(5)[of]
    table = member.T @ bigrams @ member
    for w in range(30):
        code = np.concatenate([of, of + 5])
        n = np.concatenate([bigrams[w], bigrams[:, w]])
        best = classlm.best_classes(of[[w]], np.zeros(62, dtype=np.int64), code, n, table)[0]
        moved = of.copy()
        moved[w] = best
        member = np.eye(5)[moved]
        assert best == of[w] or classlm.likelihood(member.T @ bigrams @ member) > classlm.likelihood(table) - 1


@pytest.mark.parametrize("head", [0, 2])
def test_end_token_below_the_head(spark, monkeypatch, head):
    monkeypatch.setattr(classlm, "HEAD", head)
    docs = [(i, "a b " * 40 + "c") for i in range(12)]
    want = brute(docs)
    for r in classlm.score(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect():
        held, tokens, known, n, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
