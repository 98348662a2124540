"""A part of the registered queries against their SQL twins on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from symloom.plans import queries

NAMES = ["search_and", "search_batch", "lookup_cascade_batch", "lookup_all_names", "suggest_topk", "tree_recursive", "group_by_category", "reexport_follow", "version_resolve", "summary_text", "first_paragraph", "item_name_heuristic", "signature_render", "json_lines", "recursive_listing", "variant_choice"]


def normal(value):
    return "~" if value is None else f"{value:.6g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf_tiny, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = queries.QUERIES[name](spark, sf_tiny)
    columns = sorted(found.columns)
    got = Counter(tuple(normal(r[c]) for c in columns) for r in found.collect())
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = Counter(tuple(normal(dict(zip(names, row, strict=True))[c]) for c in columns) for row in cur.fetchall())
    assert got == want and got


def test_names_agree():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
