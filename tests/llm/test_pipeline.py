import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).parent)]

import corpus_pipeline
import test_decontaminate
import test_linededup
import test_neardup


@pytest.fixture(scope="module")
def steps(spark, sf_tiny):
    """(input, output) of each stage."""
    docs, out = spark.read.parquet(f"{sf_tiny}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES:
        new = step(spark, docs, sf_tiny)
        rows = [r.asDict() for r in new.collect()]
        out[name] = ([r.asDict() for r in docs.collect()], rows)
        docs = spark.createDataFrame([tuple(r[c] for c in new.columns) for r in rows], new.schema)
    return out


def test_filters_keep_rows_whole(steps):
    for name in ("language_id", "near_dedup", "decontaminate"):
        before, after = steps[name]
        known = {r["doc_id"]: r for r in before}
        assert all(known[r["doc_id"]] == r for r in after) and len({r["doc_id"] for r in after}) == len(after), name
    before, after = steps["language_id"]
    assert len(after) >= 0.97 * len(before)


def test_lines(steps):
    before, after = steps["line_dedup"]
    want = test_linededup.brute([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicates(steps):
    before, after = steps["near_dedup"]
    want = test_neardup.brute([(r["doc_id"], r["text"]) for r in before], 5)
    assert {r["doc_id"] for r in after} == {i for i, (_, _, kept) in want.items() if kept}


def test_leaks(steps, spark, sf_tiny):
    before, after = steps["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_tiny}/benchmark.parquet").collect()]
    short = [(r["doc_id"], r["text"]) for r in before if len(r["text"]) < 3000]
    leaked = {x[0] for x in test_decontaminate.brute(short, items)}
    assert {i for i, _ in short} - leaked == {r["doc_id"] for r in after} & {i for i, _ in short}


def test_mix(steps):
    before, after = steps["mix_sources"]
    assert {r["doc_id"]: len(r["text"].split()) for r in before} == {r["doc_id"]: r["size"] for r in after}
    for source in {r["source"] for r in after}:
        own = [r for r in after if r["source"] == source]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in after)


def test_run_is_the_stages(spark, sf_tiny, steps):
    rows = [r.asDict() for r in corpus_pipeline.run(spark, sf_tiny).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, steps["mix_sources"][1]))


def test_empty_table(spark, sf_tiny):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, sf_tiny).count() == 0
