"""The registered queries of the documentation engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom import schemas
from symloom.functions import markdown
from symloom.functions import signature as sig
from symloom.functions import text as T
from symloom.operators import build, index, listing, packages, recover, render, store
from symloom.operators import lookup as L
from symloom.operators import search as S
from symloom.operators import suggest as G
from symloom.operators.store import Store, fingerprint, materialize
from symloom.sources import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_KIND_ROWS = ", ".join(f"('{k}', {c}, {str(p).lower()}, '{g}')" for k, _, c, p, g in schemas.KINDS)
CORPUS = f"""
kinds(kind, cat, prim, grp) AS (VALUES {_KIND_ROWS}),
places AS (SELECT n_nationkey, n_name, r_name, 'tpch::' || r_name || '::' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
people AS (SELECT customer.*, place || '::' || c_name AS path FROM customer JOIN places ON c_nationkey = n_nationkey),
heads AS (SELECT doc_id, text, (SELECT max(l) FROM range(0, 501) t(l) WHERE strlen(left(text, l)) <= 500) AS l FROM documents),
raw(path, name, kind, signature, docs, docs_lc, is_public, has_body, reexport_source, k) AS (
SELECT 'tpch', 'tpch', 'Module', 'pub mod tpch', '', '', true, true, CAST(NULL AS VARCHAR), 0
UNION ALL SELECT 'tpch::parts', 'parts', 'Module', 'pub mod parts', '', '', true, true, NULL, 0
UNION ALL SELECT 'tpch::prelude', 'prelude', 'Module', 'pub mod prelude', '', '', true, true, NULL, 0
UNION ALL SELECT 'tpch::' || r_name, r_name, 'Module', 'pub mod ' || r_name, '', '', true, true, NULL, 0 FROM region
UNION ALL SELECT place, n_name, 'Module', 'pub mod ' || n_name, '', '', true, true, NULL, 0 FROM places
UNION ALL SELECT path, c_name, 'Struct', 'pub struct ' || c_name || '<' || c_mktsegment || '>', coalesce(text, ''), lower(left(coalesce(text, ''), l)), c_acctbal >= 0, true, NULL, c_custkey
FROM people LEFT JOIN heads ON doc_id = c_custkey % (SELECT count(*) FROM documents)
UNION ALL SELECT place || '::' || s_name, s_name, 'Trait', 'pub trait ' || s_name, '', '', true, true, NULL, s_suppkey FROM supplier JOIN places ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 'tpch::parts::' || p_type, p_type, 'Module', 'pub mod ' || p_type, '', '', true, true, CAST(NULL AS VARCHAR), 0 FROM part
UNION ALL SELECT 'tpch::parts::' || p_type || '::' || replace(p_name, ' ', '_'), replace(p_name, ' ', '_'), 'Function', 'pub fn ' || replace(p_name, ' ', '_') || '(size: ' || p_size || ') -> ' || p_brand, '', '', true, true, NULL, p_partkey FROM part
UNION ALL SELECT path || '::order_' || o_orderkey, 'order_' || o_orderkey, 'Function', 'pub fn order_' || o_orderkey || '(&self)', '', '', true, o_orderstatus = 'F', NULL, o_orderkey FROM orders JOIN people ON o_custkey = c_custkey
UNION ALL SELECT 'tpch::prelude::' || c_name, c_name, 'Struct', 'pub use ' || path || ' as ' || c_name, '', '', true, true, path, c_custkey FROM people WHERE c_mktsegment = 'BUILDING'),
items AS (SELECT raw.*, row_number() OVER (ORDER BY path, raw.kind, k) - 1 AS item_id, string_split(path, '::') AS segs, len(string_split(path, '::')) AS depth, lower(path) AS path_lc, lower(name) AS name_lc, lower(signature) AS sig_lc,
array_to_string(string_split(path, '::')[:-2], '::') AS module_path, cat, prim, grp FROM raw JOIN kinds ON kinds.kind = raw.kind),
parents AS (SELECT path, min(item_id) AS parent_id FROM items WHERE kind IN ('Module', 'Struct', 'Enum', 'Union', 'Trait') GROUP BY path),
edges AS (SELECT parent_id, item_id AS child_id, row_number() OVER (PARTITION BY parent_id ORDER BY item_id) - 1 AS pos FROM items JOIN parents ON parents.path = items.module_path WHERE depth > 1),
full_items AS (SELECT items.*, starts_with(signature, 'pub use ') AND item_id NOT IN (SELECT parent_id FROM edges) AS is_stub FROM items)
"""


def register(oracle: str | None = None, corpus_cte: bool = True, recursive: bool = False):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{CORPUS}{oracle}" if corpus_cte else oracle
        return f

    return add


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "documents")


def _full(spark: SparkSession, sf_dir: str, extension: bool = False) -> tuple[DataFrame, DataFrame]:
    """items with stub flags, and child edges: built once for a state of the inputs, then read from the index store."""

    def build() -> dict[str, DataFrame]:
        rows = materialize(corpus.items(spark, sf_dir, extension), "corpus")
        edges = materialize(index.children(rows), "children")
        return {"items": index.with_stubs(rows, edges), "children": edges}

    name = f"{sf_dir}{'+' * extension}"
    tables = Store(spark).get(name, fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in _TABLES]), build)
    return tables["items"], tables["children"]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full(spark, sf_dir)[0]


def _values(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# Search.

def _tier(term: str) -> str:
    t = f"'{term}'"
    return f"(CASE WHEN name_lc = {t} THEN 100 WHEN contains(name_lc, {t}) THEN 75 WHEN contains(sig_lc, {t}) THEN 40 WHEN contains(lower(module_path), {t}) THEN 30 WHEN contains(docs_lc, {t}) THEN 20 ELSE 0 END)"


def _search_sql(query: str, extra: str = "true") -> str:
    groups = []
    for terms in S.parse(query):
        points = [_tier(t) for t in terms]
        groups.append(f"CASE WHEN least({', '.join(points)}) = 0 THEN 0 ELSE {' + '.join(points)} END")
    score = f"greatest({', '.join(groups)}, 0)"
    return f""", scored AS (SELECT *, {score} AS score FROM items WHERE {extra}),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, path, item_id) AS n FROM scored WHERE score > 0),
cut AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n) AS twin FROM top WHERE n <= 20)
SELECT CAST(n AS INTEGER) AS rank, item_id, path, kind, signature, CAST(score AS INTEGER) AS score FROM cut WHERE twin = 1"""


def _searcher(name: str, query: str, kind: str | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.search(_items(spark, sf_dir), query, kind)

    run.__name__ = name
    register(_search_sql(query, f"grp = '{kind}'" if kind else "true"))(run)


_searcher("search_single", "widget")
_searcher("search_and", "order 77 asia")
_searcher("search_or", "gizmo brand#1 | customer 42 | china")
_searcher("search_path", "europe")
_searcher("search_signature", "building")
_searcher("search_docs", "thning | einheit")
_searcher("search_kind", "nation_1", "Module")

BATCH = {1: "widget", 2: "order 77", 3: "africa", 4: "trait supplier", 5: "building customer | machinery 7", 6: "the", 7: "nothing matches this", 8: "brand#23 green"}


@register(", ".join(["", "scored AS (" + " UNION ALL ".join(f"SELECT {i} AS query_id, item_id, path, kind, signature, greatest(" + ", ".join(f"CASE WHEN least({', '.join(map(_tier, g))}) = 0 THEN 0 ELSE {' + '.join(map(_tier, g))} END" for g in S.parse(q)) + ", 0) AS score FROM items" for i, q in BATCH.items()) + ")",
    "top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, item_id) AS rank FROM scored WHERE score > 0)",
    "cut AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY rank) AS twin FROM top WHERE rank <= 20)"]) + " SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, item_id, path, kind, CAST(score AS INTEGER) AS score FROM cut WHERE twin = 1")
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_batch(_items(spark, sf_dir), BATCH).select("query_id", "rank", "item_id", "path", "kind", "score")


# Lookup.

ASKED = [
    (1, "tpch::ASIA::NATION_8", None), (2, "TPCH::asia::nation_8", None), (3, "tpch::asia::nation_8", None), (4, "asia::nation_8", None), (5, "NATION_8", None), (6, "nation_8", "Struct"), (7, "tpch::parts", "Struct"),
    (8, "Customer#000000007", None), (9, "customer#000000012", None), (10, "customer#000000012", "Function"), (11, "prelude::customer#000000007", None), (12, "order_7", None), (13, "order_77", "Function"), (14, "parts", None),
    (15, "blue_widget", None), (16, "BLUE_widget", None), (17, "supplier#000000003", "Trait"), (18, "nope", None), (19, "", None), (20, "tpch", None), (21, "asia", None), (22, "Asia", None), (23, "europe::nation_6::supplier#000000001", None),
]
_Q = ", ".join(f"({i}, '{t}', {'CAST(NULL AS VARCHAR)' if k is None else repr(k)})" for i, t, k in ASKED)
CASCADE = f""", q0(query_id, text, kf) AS (VALUES {_Q}),
q AS (SELECT *, lower(text) AS q_lc, string_split(text, '::') AS q_segs, len(string_split(text, '::')) AS q_n, regexp_matches(text, '\\p{{Lu}}') AS cased FROM q0 WHERE text <> ''),
suffixes AS (SELECT item_id, lower(array_to_string(segs[i:], '::')) AS suffix_lc FROM (SELECT item_id, segs, unnest(range(1, depth + 1)) AS i FROM items)),
c0 AS (SELECT q.*, 1 AS stage, item_id FROM q JOIN items ON path = text UNION ALL SELECT q.*, 2, item_id FROM q JOIN items ON path_lc = q_lc
UNION ALL SELECT q.*, 3, item_id FROM q JOIN suffixes ON suffix_lc = q_lc UNION ALL SELECT q.*, 4, item_id FROM q JOIN items ON name_lc = q_lc WHERE q_n = 1),
c1 AS (SELECT c0.*, i.path, i.name, i.kind, i.segs, i.depth, i.path_lc, i.prim, i.reexport_source, i.is_stub,
(kf IS NULL OR i.grp = kf) AND (stage = 1 OR NOT cased OR CASE WHEN q_n = 1 THEN i.name = text ELSE i.segs[-q_n:] = q_segs END) AS ok,
stage = 3 AND q_n = 1 AND len(list_filter(i.segs[:-2], lambda s: lower(s) = q_lc)) > 0 AS dup FROM c0 JOIN full_items i USING (item_id)),
c2 AS (SELECT *, CASE WHEN bool_or(stage = 1) OVER (PARTITION BY query_id) THEN 1 ELSE min(CASE WHEN ok THEN stage END) OVER (PARTITION BY query_id) END AS chosen FROM c1),
c3 AS (SELECT * FROM c2 WHERE ok AND stage = chosen),
c4 AS (SELECT *, item_id AS pos FROM c3 c WHERE dup = (SELECT bool_and(dup) FROM c3 d WHERE d.query_id = c.query_id)),
"""
CLASSIFY = """canon AS (SELECT name, min(item_id) AS c_id FROM full_items WHERE NOT is_stub GROUP BY name),
s1 AS (SELECT c.query_id, c.pos, CASE WHEN c.is_stub AND c_id IS NOT NULL THEN c_id ELSE c.item_id END AS item_id FROM c4 c LEFT JOIN canon ON canon.name = c.name
WHERE NOT (c.is_stub AND EXISTS (SELECT 1 FROM c4 d WHERE d.query_id = c.query_id AND d.name = c.name AND NOT d.is_stub))),
s2 AS (SELECT s1.*, i.path, i.path_lc, i.kind, i.depth, i.prim, lower(i.reexport_source) AS src, count(*) OVER (PARTITION BY query_id) AS n0 FROM s1 JOIN full_items i USING (item_id)),
s3 AS (SELECT *, coalesce(src, CASE WHEN EXISTS (SELECT 1 FROM s2 d WHERE d.query_id = s2.query_id AND d.src = s2.path_lc) THEN path_lc END) AS ident FROM s2),
s4 AS (SELECT *, row_number() OVER (PARTITION BY query_id, ident, kind ORDER BY depth, pos, item_id) AS best FROM s3),
s5 AS (SELECT *, row_number() OVER (PARTITION BY query_id, path, kind ORDER BY pos, item_id) AS twin FROM s4 WHERE n0 <= 1 OR ident IS NULL OR best = 1),
s6 AS (SELECT *, count(*) OVER w AS n, count(CASE WHEN depth = 2 AND prim THEN 1 END) OVER w = 1 AND count(CASE WHEN depth = 2 AND NOT prim THEN 1 END) OVER w = 0 AND count(CASE WHEN depth = 3 AND prim THEN 1 END) OVER w = 0 AS auto,
CASE WHEN depth = 2 AND prim THEN 0 WHEN depth = 2 THEN 1 ELSE 2 END AS bucket FROM s5 WHERE twin = 1 WINDOW w AS (PARTITION BY query_id)),
s7 AS (SELECT *, CASE WHEN n = 1 OR auto THEN 'Found' ELSE 'Ambiguous' END AS status, row_number() OVER (PARTITION BY query_id ORDER BY bucket, CASE WHEN bucket = 2 THEN depth ELSE 0 END, path, pos, item_id) AS rank FROM s6 WHERE n = 1 OR NOT auto OR bucket = 0)
SELECT CAST(q0.query_id AS BIGINT) AS query_id, coalesce(status, 'NotFound') AS status, CAST(rank AS INTEGER) AS rank, item_id, path, kind FROM q0 LEFT JOIN s7 ON s7.query_id = q0.query_id"""


def _asked(spark: SparkSession) -> DataFrame:
    return _values(spark, [(i, "tpch", t, k) for i, t, k in ASKED], "query_id long, package string, text string, kf string")


@register(CASCADE + CLASSIFY)
def lookup_cascade_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lookup(_asked(spark), _full(spark, sf_dir)[0])


def _stage(name: str, number: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = L.stage(L.prepare(_asked(spark)), _full(spark, sf_dir)[0], number)
        return hits.select("query_id", "item_id", "path", L.admitted().alias("ok"))

    run.__name__ = name
    register(CASCADE.rsplit(",\nc2", 1)[0] + f" SELECT CAST(query_id AS BIGINT) AS query_id, item_id, path, ok FROM c1 WHERE stage = {number}")(run)


for _n, _name in enumerate(("lookup_exact", "lookup_ci", "lookup_suffix", "lookup_name"), 1):
    _stage(_name, _n)


@register(CASCADE.rstrip(",\n") + " SELECT CAST(query_id AS BIGINT) AS query_id, CAST(stage AS INTEGER) AS stage, item_id FROM c4")
def lookup_nondup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.candidates(_asked(spark), _full(spark, sf_dir)[0]).select("query_id", "stage", "item_id")


@register(", c4 AS (SELECT i.name AS query_id, i.item_id, i.item_id AS pos, i.name, i.is_stub FROM full_items i), " + CLASSIFY.split("SELECT CAST(q0")[0] + " SELECT query_id AS name, status, CAST(rank AS INTEGER) AS rank, item_id, path FROM s7")
def lookup_all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct name of the corpus classified at once: stubs, identities, twins, auto-selection, order."""
    items, _ = _full(spark, sf_dir)
    found = items.select(*L.COLUMNS).withColumn("query_id", F.col("name")).withColumn("pos", F.col("item_id"))
    return L.classify(found, items).select(F.col("query_id").alias("name"), "status", "rank", "item_id", "path")


@register(", t AS (SELECT *, row_number() OVER (PARTITION BY path, kind ORDER BY item_id) AS n FROM items) SELECT item_id, path, kind FROM t WHERE n = 1")
def dedup_path_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).withColumn("query_id", F.lit(0)).withColumn("pos", F.col("item_id"))
    return L.distinct_path_kind(rows).select("item_id", "path", "kind")


METHODS = [(1, "tpch::ASIA", "nation_8", None), (2, "customer#000000007", "order_7", None), (3, "tpch::prelude", "Customer#000000010", None), (4, "parts", "nothing", None), (5, "absent", "x", None), (6, "tpch", "asia", "Module"), (7, "tpch", "asia", "Struct")]


@register(f""", m(query_id, parent, method, kf) AS (VALUES {", ".join(f"({i}, '{p}', '{m}', {'CAST(NULL AS VARCHAR)' if k is None else repr(k)})" for i, p, m, k in METHODS)})
SELECT CAST(m.query_id AS BIGINT) AS query_id, c.item_id, c.path FROM m JOIN items p ON p.path_lc = lower(m.parent) OR p.path_lc = 'tpch::' || lower(m.parent) JOIN edges ON parent_id = p.item_id JOIN full_items c ON c.item_id = child_id
WHERE c.name_lc = lower(m.method) AND (m.kf IS NULL OR c.grp = m.kf) AND NOT c.is_stub AND (NOT regexp_matches(m.method, '\\p{{Lu}}') OR c.name = m.method)""")
def method_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, edges = _full(spark, sf_dir)
    asked = _values(spark, [(i, "tpch", p, m, k) for i, p, m, k in METHODS], "query_id long, package string, parent string, method string, kf string")
    hits = L.lookup_method(asked, items, edges).filter("status = 'Found'")
    return hits.join(items.filter("NOT is_stub").select("item_id"), "item_id", "left_semi").select("query_id", "item_id", "path")


NEAR = [(1, "blue_widgit"), (2, "nation_99"), (3, "tpch::azia"), (4, "Supplier#00000003"), (5, "ordr_77"), (6, "partz"), (7, "qqqqqqqqqq"), (8, "eu")]


def _admit(a: str, b: str) -> str:
    return f"(abs(strlen({a}) - strlen({b})) <= 3 AND NOT (strlen({a}) > 2 AND strlen({b}) > 2 AND left({a}, 1) <> left({b}, 1) AND abs(strlen({a}) - strlen({b})) >= 3))"


@register(f""", q(query_id, text) AS (VALUES {", ".join(f"({i}, '{t}')" for i, t in NEAR)}),
d AS (SELECT DISTINCT query_id, lower(text) AS t, lower(string_split(text, '::')[-1]) AS l, path, path_lc, name_lc FROM q, items),
s AS (SELECT query_id, path, min(least(levenshtein(t, path_lc), levenshtein(t, name_lc), levenshtein(l, name_lc))) AS distance FROM d WHERE {_admit('t', 'path_lc')} OR {_admit('t', 'name_lc')} OR {_admit('l', 'name_lc')} GROUP BY query_id, path),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, path) AS rank FROM s WHERE distance <= 3)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, CAST(distance AS INTEGER) AS distance, path FROM r WHERE rank <= 5""")
def suggest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _values(spark, [(i, "tpch", t) for i, t in NEAR], "query_id long, package string, text string")
    return G.suggestions(asked, _items(spark, sf_dir))


@register(f""", r AS (SELECT parent_id AS query_id, path, min(levenshtein('order_7', name_lc)) AS distance FROM edges JOIN items ON item_id = child_id WHERE {_admit("'order_7'", 'name_lc')} GROUP BY parent_id, path),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, path) AS rank FROM r WHERE distance <= 3)
SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(distance AS INTEGER) AS distance, path FROM s WHERE rank <= 5""")
def suggest_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, edges = _full(spark, sf_dir)
    asked = edges.select("package", "parent_id").distinct().withColumn("query_id", F.col("parent_id")).withColumn("method", F.lit("order_7"))
    return G.child_suggestions(asked, items, edges)


# Listings.

def _tree_sql(root: str, kind: str | None = None) -> str:
    return f""", mods AS (SELECT path, min(item_id) AS item_id FROM items WHERE kind = 'Module' AND (is_public OR path = '{root}') GROUP BY path),
walk(item_id, level) AS (SELECT item_id, 0 FROM mods WHERE path = '{root}' UNION ALL SELECT child_id, level + 1 FROM walk JOIN edges ON parent_id = walk.item_id WHERE child_id IN (SELECT item_id FROM mods)),
below AS (SELECT i.item_id, i.path, i.kind, i.grp, w.level + 1 AS level, row_number() OVER (PARTITION BY i.path, i.kind ORDER BY w.level, i.item_id) AS twin FROM walk w JOIN edges ON parent_id = w.item_id JOIN items i ON i.item_id = child_id WHERE i.is_public)
SELECT item_id, path, kind, CAST(level AS INTEGER) AS level FROM below WHERE twin = 1{f" AND grp = '{kind}'" if kind else ''}"""


def _treer(name: str, root: str, kind: str | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        items, edges = _full(spark, sf_dir)
        return listing.tree(items, edges, root, kind).select("item_id", "path", "kind", "level")

    run.__name__ = name
    register(_tree_sql(root, kind), recursive=True)(run)


_treer("tree_recursive", "tpch")
_treer("tree_kind_filter", "tpch", "Function")


@register(", r AS (SELECT parent_id, c.cat, c.item_id, c.name, row_number() OVER (PARTITION BY parent_id, c.cat ORDER BY c.name, pos) AS rank FROM edges JOIN items p ON p.item_id = parent_id JOIN items c ON c.item_id = child_id WHERE p.kind = 'Module' AND c.is_public) SELECT parent_id, CAST(cat AS INTEGER) AS cat, CAST(rank AS INTEGER) AS rank, item_id, name FROM r")
def group_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, edges = _full(spark, sf_dir)
    return listing.by_category(items, edges, items.filter("kind = 'Module'")).select("parent_id", "cat", "rank", "item_id", "name")


@register(" SELECT CASE WHEN module_path = '' THEN 'tpch' ELSE module_path END AS module_path, count(*) AS n_items, CAST(max(strlen(path)) AS INTEGER) AS widest FROM items GROUP BY 1")
def group_by_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.by_module(_items(spark, sf_dir)).select("module_path", "n_items", "widest")


@register(", r AS (SELECT parent_id, CASE WHEN c.kind = 'Function' THEN 'methods' ELSE 'variants' END AS part, c.item_id, c.name, pos FROM edges JOIN items p ON p.item_id = parent_id JOIN items c ON c.item_id = child_id WHERE p.prim AND c.kind IN ('Function', 'Variant')) SELECT parent_id, part, CAST(row_number() OVER (PARTITION BY parent_id, part ORDER BY name, pos) AS INTEGER) AS rank, item_id, name FROM r")
def type_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.type_children(*_full(spark, sf_dir)).select("parent_id", "part", "rank", "item_id", "name")


@register(" SELECT parent_id, CASE WHEN c.has_body THEN 'provided' ELSE 'required' END AS part, CAST(row_number() OVER (PARTITION BY parent_id, c.has_body ORDER BY pos) AS INTEGER) AS rank, c.item_id, c.name FROM edges JOIN items p ON p.item_id = parent_id JOIN items c ON c.item_id = child_id WHERE p.kind = 'Struct' AND c.grp = 'Function'")
def trait_methods_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, edges = _full(spark, sf_dir)
    return listing.methods_split(items, edges, items.filter("kind = 'Struct'")).select("parent_id", "part", "rank", "item_id", "name")


_IMPLS = ", ti AS (SELECT DISTINCT path, o_orderpriority AS trait_path, o_orderpriority >= '4' AS is_synthetic FROM orders JOIN people ON o_custkey = c_custkey)"


@register(_IMPLS + " SELECT path, trait_path, is_synthetic, CAST(row_number() OVER (PARTITION BY path ORDER BY is_synthetic, trait_path) AS INTEGER) AS rank FROM ti")
def impls_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.impls(corpus.trait_impls(spark, sf_dir), ["path"])


@register(_IMPLS + " SELECT path, trait_path, is_synthetic, CAST(row_number() OVER (PARTITION BY path ORDER BY is_synthetic, trait_path) AS INTEGER) AS rank FROM ti WHERE contains(lower(trait_path), 'high')")
def impls_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.impls(corpus.trait_impls(spark, sf_dir), ["path"], "HIGH")


@register(" SELECT item_id, lower(array_to_string(segs[i:], '::')) AS suffix_lc FROM (SELECT item_id, segs, unnest(range(1, depth + 1)) AS i FROM items)")
def suffix_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.suffix_table(_items(spark, sf_dir)).select("item_id", "suffix_lc")


# Re-exports.

@register(" SELECT s.item_id AS query_id, t.item_id, t.path, t.kind FROM full_items s JOIN (SELECT path, min(item_id) AS item_id, any_value(kind) AS kind FROM items GROUP BY path) t ON t.path = s.reexport_source WHERE s.is_stub")
def reexport_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = _full(spark, sf_dir)
    stubs = items.filter("is_stub").select(F.col("item_id").alias("query_id"), "reexport_source", "signature")
    return recover.follow(stubs, items).select("query_id", "item_id", "path", "kind")


@register(", f AS (SELECT name, is_stub, item_id, path, kind, row_number() OVER (PARTITION BY name ORDER BY is_stub, item_id) AS n FROM full_items) SELECT name, item_id, path, kind FROM f WHERE n = 1")
def reexport_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = _full(spark, sf_dir)
    asked = items.select("package", "name").distinct().withColumn("query_id", F.col("name"))
    return recover.by_name(asked, items).select(F.col("query_id").alias("name"), "item_id", "path", "kind")


@register(" SELECT s.name || '::' || c.name AS query_id, c.item_id, c.path, c.kind FROM full_items s JOIN items t ON t.path = s.reexport_source JOIN edges ON parent_id = t.item_id JOIN items c ON c.item_id = child_id WHERE s.is_stub")
def reexport_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prelude::<customer>::<order>`` for every order of a re-exported customer."""
    items, edges = _full(spark, sf_dir)
    stubs = items.filter("is_stub").select("name", "reexport_source")
    kids = edges.join(items.select(F.col("item_id").alias("parent_id"), F.col("path").alias("reexport_source")), "parent_id").join(items.select(F.col("item_id").alias("child_id"), F.col("name").alias("child")), "child_id")
    asked = stubs.join(kids, "reexport_source").select(F.concat_ws("::", "name", "child").alias("query_id"), F.lit("tpch").alias("package"), F.array(F.lit("prelude"), "name", "child").alias("segments"))
    return recover.by_prefix(asked, items).select("query_id", "item_id", "path", "kind")


@register("""SELECT s_name AS query_id, 'tpch_ext::' || s_name AS path, 'Struct' AS kind, 'tpch_ext' AS package FROM supplier""", corpus_cte=False)
def reexport_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prelude::<supplier>`` for every supplier, through a glob re-export of the second package."""
    items, _ = _full(spark, sf_dir, extension=True)
    globs = _values(spark, [("tpch", "prelude", "tpch_ext")], schemas.GLOB_USES)
    asked = corpus.read(spark, sf_dir, "supplier").select(F.col("s_name").alias("query_id"), F.lit("tpch").alias("package"), F.array(F.lit("prelude"), "s_name").alias("segments"))
    return recover.by_glob(asked, items, globs).select("query_id", "path", "kind", "package")


# Packages and versions.

@register(""" WITH n AS (SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT 'core' UNION SELECT 'auto-mobile' UNION SELECT 'house_hold' UNION SELECT 'left'),
p(rank, source_type, pos, name, package) AS (VALUES (0, 'Current', 0, 'BUILDING', 'building'), (1, 'Dependency', 0, 'auto_mobile', 'AUTOMOBILE'), (1, 'Dependency', 1, 'house-hold', 'HOUSEHOLD'), (2, 'Member', 0, 'MACHINERY', 'machinery'), (2, 'Member', 1, 'BUILDING', 'other'), (3, 'Graph', 0, 'FURNITURE', 'furniture'), (3, 'Graph', 1, 'core', 'core'))
SELECT n.name, coalesce(arg_min(p.source_type, p.rank), CASE WHEN n.name IN ('std', 'core', 'alloc') THEN 'Stdlib' ELSE 'External' END) AS source_type, coalesce(arg_min(p.package, p.rank), n.name) AS package FROM n LEFT JOIN p ON replace(p.name, '-', '_') = replace(n.name, '-', '_') GROUP BY n.name""", corpus_cte=False)
def package_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = corpus.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).unionByName(_values(spark, [("core",), ("auto-mobile",), ("house_hold",), ("left",)], "name string"))
    graph = lambda rows: _values(spark, rows, "pos int, name string, package string")
    return packages.resolve(names, graph([(0, "BUILDING", "building")]), graph([(0, "auto_mobile", "AUTOMOBILE"), (1, "house-hold", "HOUSEHOLD")]), graph([(0, "MACHINERY", "machinery"), (1, "BUILDING", "other")]), graph([(0, "FURNITURE", "furniture"), (1, "core", "core")]))


@register("""WITH v AS (SELECT p_brand AS package, p_size AS major, p_partkey % 7 AS minor, p_partkey % 11 AS patch, p_retailprice > 1500 AS yanked FROM part),
w AS (SELECT DISTINCT package, CAST(major AS VARCHAR) AS wanted, major, CAST(NULL AS BIGINT) AS minor FROM v UNION SELECT DISTINCT package, major || '.' || minor, major, minor FROM v),
r AS (SELECT w.package, w.wanted, v.major || '.' || v.minor || '.' || v.patch AS version, row_number() OVER (PARTITION BY w.package, w.wanted ORDER BY v.major DESC, v.minor DESC, v.patch DESC) AS n FROM w JOIN v ON v.package = w.package AND v.major = w.major AND (w.minor IS NULL OR v.minor = w.minor) AND NOT yanked)
SELECT w.package, w.wanted, r.version FROM w LEFT JOIN r ON r.package = w.package AND r.wanted = w.wanted AND r.n = 1""", corpus_cte=False)
def version_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = corpus.read(spark, sf_dir, "part")
    size, minor = F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string")
    versions = part.select(F.col("p_brand").alias("package"), F.concat_ws(".", size, minor, (F.col("p_partkey") % 11).cast("string")).alias("num"), (F.col("p_retailprice") > 1500).alias("yanked"))
    asked = part.select(F.col("p_brand").alias("package"), F.explode(F.array(size, F.concat_ws(".", size, minor))).alias("wanted")).distinct()
    return packages.resolve_version(asked, versions)


# Text functions over all documents, and log lines.

@register(r"""WITH t AS (SELECT doc_id, text, regexp_extract(text, '(?s)^(.*?)(?:(\.)(?:\s+\p{Lu}|\s*\z)|([!?])(?:\s|\z))', ['a', 'b', 'c']) AS m, string_split(text, chr(10))[1] AS line FROM documents)
SELECT doc_id, CASE WHEN m.a || m.b || m.c <> '' THEN m.a || m.b || m.c WHEN strlen(line) <= 100 THEN line ELSE left(line, (SELECT max(l) FROM range(0, 101) r(l) WHERE strlen(left(line, l)) <= 100)) || '...' END AS summary FROM t""", corpus_cte=False)
def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.read(spark, sf_dir, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


@register("SELECT doc_id, left(text, (SELECT max(l) FROM range(0, 501) r(l) WHERE strlen(left(text, l)) <= 500)) AS prefix FROM documents", corpus_cte=False)
def utf8_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.read(spark, sf_dir, "documents").select("doc_id", T.utf8_prefix(F.col("text"), 500).alias("prefix"))


@register(r"""WITH h AS (SELECT doc_id, text, left(text, (SELECT max(l) FROM range(0, 1501) r(l) WHERE strlen(left(text, l)) <= 1500)) AS head FROM documents),
x AS (SELECT *, regexp_extract(head, '(?s)\A(.*)\n\n', 1) AS para, regexp_extract(head, '(?s)\A(.*[.!?]) ', 1) AS sent, regexp_extract(head, '(?s)\A(.*) ', 1) AS word FROM h)
SELECT doc_id, CASE WHEN strlen(text) <= 1500 THEN text WHEN para <> '' THEN rtrim(para, ' ' || chr(10) || chr(9) || chr(13)) || '...' WHEN sent <> '' THEN sent WHEN word <> '' THEN rtrim(word, ' ' || chr(10) || chr(9) || chr(13)) || '...' ELSE head || '...' END AS short FROM x""", corpus_cte=False)
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.read(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text")).alias("short"))


@register(r"""WITH x AS (SELECT doc_id, text, regexp_extract(text, '(?s)\A(.*?[.!?]) (?:.*)', 1) AS s1, left(text, (SELECT max(l) FROM range(0, 201) r(l) WHERE strlen(left(text, l)) <= 200)) AS head, string_split(text, chr(10))[1] AS line, regexp_extract(text, '(?s)\A(.*?[.!?] .*?[.!?] .*?[.!?]) ', 1) AS s3 FROM documents)
SELECT doc_id, CASE WHEN contains(text, chr(10) || chr(10)) THEN string_split(text, chr(10) || chr(10))[1] WHEN s3 <> '' THEN s3 WHEN right(text, 1) IN ('.', '!', '?') THEN text WHEN strlen(text) <= 200 THEN text
WHEN contains(text, chr(10)) AND strlen(line) <= 200 THEN line WHEN contains(head, ' ') THEN regexp_extract(head, '(?s)\A(.*) ', 1) || '...' ELSE head || '...' END AS paragraph FROM x""", corpus_cte=False)
def first_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.read(spark, sf_dir, "documents").select("doc_id", T.first_paragraph(F.col("text")).alias("paragraph"))


@register()
def markdown_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.read(spark, sf_dir, "documents").select("doc_id", markdown.strip_markdown(F.col("text")).alias("plain"))


@register("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS source, CAST(2 AS INTEGER) AS line_start, CAST(3 AS INTEGER) AS line_end FROM documents", corpus_cte=False)
def source_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    spans = files.select("file", F.lit(2).alias("line_start"), F.lit(3).alias("line_end"))
    return listing.source_slice(files, spans).select(F.col("file").cast("long").alias("doc_id"), "source", "line_start", "line_end")


@register(r"""WITH n AS (SELECT DISTINCT unnest([replace(p_name, ' ', '_'), p_name, string_split(p_name, ' ')[1], p_brand, replace(p_type, ' ', '-')]) AS name FROM part)
SELECT name, CASE WHEN name = '' OR contains(name, '-') THEN false WHEN regexp_matches(name, '\p{Lu}') THEN true
WHEN contains(name, '_') THEN NOT (len(string_split(name, '_')) <= 3 AND regexp_full_match(replace(name, '_', ''), '[\p{Ll}0-9]*') AND (strlen(name) - len(string_split(name, '_')) + 1) // len(string_split(name, '_')) <= 6)
ELSE strlen(name) <= 4 OR name IN ('clone', 'default', 'into', 'from', 'borrow', 'deref', 'format', 'parse', 'write', 'read', 'open', 'close', 'send', 'recv') END AS as_item FROM n""", corpus_cte=False)
def item_name_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = corpus.read(spark, sf_dir, "part")
    names = part.select(F.explode(F.array(F.translate("p_name", " ", "_"), "p_name", F.get(F.split("p_name", " "), F.lit(0)), "p_brand", F.translate("p_type", " ", "-"))).alias("name")).distinct()
    return names.select("name", T.looks_like_item(F.col("name")).alias("as_item"))


_LOGS = [("error: linking with `cc` failed: ld: library not found for -lssl",), ("Could Not Find native static library",), ("error[E0308]: mismatched types",), ("warning: linker stderr: Error",), ("error: no library targets found in package `tool`",), ("",)]


@register(f"""WITH l(log) AS (VALUES {", ".join("('" + x[0].replace("'", "''") + "')" for x in _LOGS)} UNION ALL SELECT text FROM conversations),
s AS (SELECT log, lower(log) AS low FROM l)
SELECT log, {" OR ".join(f"contains(low, '{p.lower()}')" for p in T.FAILURES)} OR {" OR ".join(f"(contains(low, '{a}') AND contains(low, '{b}'))" for a, b in T.FAILURE_PAIRS)} AS platform, nullif(regexp_extract(log, 'no library targets found in package `([^`]*)`', 1), '') AS no_library FROM s""", corpus_cte=False)
def failure_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _values(spark, _LOGS, "log string").unionByName(corpus.read(spark, sf_dir, "conversations").select(F.col("text").alias("log")))
    return logs.select("log", T.is_platform_failure(F.col("log")).alias("platform"), T.no_library_target(F.col("log")).alias("no_library"))


# Signatures, views and build tables.

@register("""SELECT p_partkey, 'pub const fn ' || replace(p_name, ' ', '_') || '<T: Clone>(&mut self, size: &''a [u8; ' || p_size || '], f: impl Fn(T) -> Option<u8>) -> Result<' || replace(p_type, ' ', '') || ', (T, u8)> where T: Send' AS signature FROM part""", corpus_cte=False)
def signature_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function item with generics, references, arrays, bounds and a where-clause for every part."""
    tree = """{"id":1,"name":"%s","visibility":"public","inner":{"function":{"header":{"is_const":true,"is_unsafe":false,"is_async":false,"abi":"Rust"},"has_body":true,
    "generics":{"params":[{"name":"T","kind":{"type":{"bounds":[{"trait_bound":{"trait":{"path":"Clone","id":2,"args":null},"generic_params":[],"modifier":"none"}}],"default":null,"is_synthetic":false}}}],
    "where_predicates":[{"bound_predicate":{"type":{"generic":"T"},"bounds":[{"trait_bound":{"trait":{"path":"Send","id":3,"args":null},"generic_params":[],"modifier":"none"}}],"generic_params":[]}}]},
    "sig":{"is_c_variadic":false,"inputs":[["self",{"borrowed_ref":{"lifetime":null,"is_mutable":true,"type":{"generic":"Self"}}}],["size",{"borrowed_ref":{"lifetime":"'a","is_mutable":false,"type":{"array":{"type":{"primitive":"u8"},"len":"%s"}}}}],
    ["f",{"impl_trait":[{"trait_bound":{"trait":{"path":"Fn","id":4,"args":{"parenthesized":{"inputs":[{"generic":"T"}],"output":{"resolved_path":{"path":"Option","id":5,"args":{"angle_bracketed":{"args":[{"type":{"primitive":"u8"}}],"constraints":[]}}}}}}},"generic_params":[],"modifier":"none"}}]}]],
    "output":{"resolved_path":{"path":"Result","id":6,"args":{"angle_bracketed":{"args":[{"type":{"resolved_path":{"path":"%s","id":7,"args":null}}},{"type":{"tuple":[{"generic":"T"},{"primitive":"u8"}]}}],"constraints":[]}}}}}}}}"""
    part = corpus.read(spark, sf_dir, "part")
    item = F.format_string(tree, F.translate("p_name", " ", "_"), F.col("p_size").cast("string"), F.replace("p_type", F.lit(" "), F.lit("")))
    return part.select("p_partkey", sig.render_signature(item, F.array().cast("array<string>")).alias("signature"))


@register(""", lines AS (SELECT item_id, 0 AS line_no, path, kind, signature FROM items WHERE kind = 'Module' UNION ALL
SELECT parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY c.cat, c.name, pos), c.path, c.kind, c.signature FROM edges JOIN items p ON p.item_id = parent_id AND p.kind = 'Module' JOIN items c ON c.item_id = child_id AND c.is_public)
SELECT item_id, CAST(line_no AS BIGINT) AS line_no, path, signature FROM lines""")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of all modules and their children, read back."""
    items, edges = _full(spark, sf_dir)
    none = _values(spark, [], schemas.TRAIT_IMPLS)
    lines = render.json_items(_plain(items), edges, none, items.filter("kind = 'Module'"))
    return lines.select("item_id", "line_no", F.get_json_object("line", "$.path").alias("path"), F.get_json_object("line", "$.signature").alias("signature"))


def _plain(items: DataFrame) -> DataFrame:
    """Corpus rows with the columns that views show."""
    return items.withColumn("summary", T.summary(F.col("docs"))).withColumn("feature_gate", F.lit(None).cast("string"))


@register()
def text_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default view of every module and type."""
    items, edges = _full(spark, sf_dir)
    impls = listing.impls(corpus.trait_impls(spark, sf_dir), ["path"]).join(items.filter("NOT is_stub").select("package", "item_id", "path"), "path")
    rows = impls.select("package", "item_id", F.col("rank").alias("pos"), "trait_path", "is_synthetic")
    return render.text(_plain(items), edges, rows, items.filter("kind IN ('Module', 'Struct', 'Trait')")).select("item_id", "text")


_SHORT = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s, *_ in schemas.KINDS) + " END"


@register(f""", wanted AS (SELECT *, {_SHORT} AS short FROM items WHERE kind IN ('Module', 'Struct', 'Trait')),
kids AS (SELECT p.item_id AS pid, p.kind AS pk, c.cat, c.name, c.kind, row_number() OVER (PARTITION BY parent_id, c.cat ORDER BY c.name, pos) AS place FROM edges JOIN wanted p ON p.item_id = parent_id JOIN items c ON c.item_id = child_id WHERE p.kind <> 'Module' OR c.is_public),
named AS (SELECT *, {_SHORT} AS short, max(strlen({_SHORT})) OVER (PARTITION BY pid) AS width FROM kids),
l AS (SELECT item_id, 0 AS section, 0 AS sub, 0 AS rank, CASE WHEN depth = 1 AND kind = 'Module' THEN 'crate' ELSE short END || ' ' || path AS line FROM wanted
UNION ALL SELECT pid, 1, cat, place, '  ' || rpad(short, CAST(width AS INTEGER), ' ') || '  ' || name FROM named WHERE pk = 'Module' UNION ALL SELECT pid, 1, 1, place, '  fn       ' || name FROM named WHERE pk = 'Struct' AND kind = 'Function')
SELECT item_id, string_agg(line, chr(10) ORDER BY section, sub, rank, line) AS text FROM l GROUP BY item_id""")
def brief_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, edges = _full(spark, sf_dir)
    return render.brief(_plain(items), edges, items.filter("kind IN ('Module', 'Struct', 'Trait')")).select("item_id", "text")




@register(f""", w AS (SELECT max(strlen({_SHORT})) AS wk, max(strlen(path)) AS wp FROM items),
l AS (SELECT CASE WHEN module_path = '' THEN 'tpch' ELSE module_path END AS module_path, path, item_id, '  ' || {_SHORT} || repeat(' ', wk - strlen({_SHORT})) || '  ' || path || repeat(' ', wp - strlen(path)) || '  ' || signature AS line FROM items, w)
SELECT module_path, module_path || ':' || chr(10) || string_agg(line, chr(10) ORDER BY path, item_id) AS lines FROM l GROUP BY module_path""")
def recursive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.listed(_plain(_items(spark, sf_dir))).select("module_path", "lines")


@register(_IMPLS + " SELECT path, trait_path, is_synthetic FROM ti WHERE trait_path = '1-URGENT'")
def implementors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.implementors(corpus.trait_impls(spark, sf_dir), "1-URGENT").select("path", "trait_path", "is_synthetic")


@register("SELECT p_brand AS package, arg_min(p_type, (p_size % 4) || ':' || p_type) AS variant_key FROM part GROUP BY 1", corpus_cte=False)
def variant_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    strategy = F.element_at(F.array(*[F.lit(x) for x in ("explicit", "documented", "all", "default")]), (F.col("p_size") % 4 + 1).cast("int"))
    return packages.choose_variant(corpus.read(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), strategy.alias("strategy"), F.col("p_type").alias("variant_key")))


@register("SELECT DISTINCT p_brand AS package, CAST(p_size AS VARCHAR) AS version FROM part WHERE p_brand || '@' || p_size NOT IN (SELECT p_brand || '@' || p_size FROM part WHERE p_retailprice > 1500)", corpus_cte=False)
def known_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = corpus.read(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), F.col("p_size").cast("string").alias("version"), "p_retailprice")
    failed = part.filter("p_retailprice > 1500").select(F.concat_ws("@", "package", "version").alias("name_version"))
    return store.known_failures(part.select("package", "version").distinct(), failed)


# Output of searches, messages, sources, listings.

_WIDGETS = _search_sql("widget").rsplit("SELECT CAST(n", 1)[0].rstrip()


@register(_WIDGETS + f", o AS (SELECT n, path, {_SHORT} AS short FROM cut WHERE twin = 1), w AS (SELECT max(strlen(short)) AS wk, max(strlen(path)) AS wp FROM o) SELECT count(*) || ' results for \"widget\":' || chr(10) || chr(10) || string_agg(rpad(short, CAST(wk AS INTEGER), ' ') || '  ' || rpad(path, CAST(wp AS INTEGER), ' '), chr(10) ORDER BY n) AS text FROM o, w")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.as_text(S.search(_plain(_items(spark, sf_dir)), "widget"), "widget")


@register(_WIDGETS + f""" SELECT CAST(n AS INTEGER) AS rank, '{{"kind":"' || {_SHORT} || '","path":"' || path || '","score":' || score || ',"signature":"' || signature || '","summary":""}}' AS line FROM cut WHERE twin = 1""")
def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.as_json(S.search(_plain(_items(spark, sf_dir)), "widget"))


@register(_search_sql("brand").rsplit("SELECT CAST(n", 1)[0] + "SELECT count(*) AS n_wider FROM cut WHERE twin = 1")
def search_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search without hits among the modules only, and what the whole index would give."""
    items = _items(spark, sf_dir)
    return S.hint(items.filter("kind = 'Module'"), items, "brand")


@register(ORACLE_SQL["suggest_topk"].split("WITH ", 1)[1].removeprefix(CORPUS).rsplit("SELECT CAST(query_id AS BIGINT)", 1)[0] + """, m AS (SELECT query_id, string_agg(chr(10) || '  ' || path, '' ORDER BY rank) AS near FROM r WHERE rank <= 5 GROUP BY query_id)
SELECT CAST(q.query_id AS BIGINT) AS query_id, 'no item matching "' || text || '" in crate ''tpch''' || CASE WHEN near IS NULL THEN '' ELSE chr(10) || chr(10) || 'Did you mean:' || near END AS message, 1 AS exit_code FROM q LEFT JOIN m ON m.query_id = q.query_id""")
def not_found_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _values(spark, [(i, "tpch", t) for i, t in NEAR], "query_id long, package string, text string")
    return G.not_found(asked, asked.select("query_id", F.lit("NotFound").alias("status")), _items(spark, sf_dir)).select("query_id", "message", "exit_code")


@register("""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS x FROM documents WHERE text <> '')
SELECT doc_id, CASE WHEN len(x) < 2 THEN '// source not available (Could not read ' || doc_id || ')' ELSE rtrim('fn docs::d' || doc_id || '  ' || doc_id || ':2-3' || chr(10) || array_to_string(x[2:3], chr(10)), chr(10)) END AS text FROM l""", corpus_cte=False)
def source_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second and third line of every document as the source of a function."""
    docs = corpus.read(spark, sf_dir, "documents").filter("text <> ''")
    file = F.col("doc_id").cast("string")
    files = docs.select(F.lit("docs").alias("package"), file.alias("file"), "text")
    items = docs.select(F.lit("docs").alias("package"), F.col("doc_id").alias("item_id"), F.concat(F.lit("docs::d"), file).alias("path"), F.concat(F.lit("d"), file).alias("name"), F.lit("Function").alias("kind"), F.lit(2).alias("depth"), F.lit("").alias("docs"), F.lit(None).cast("string").alias("feature_gate"), F.struct(file.alias("file"), F.lit(2).alias("line_start"), F.lit(3).alias("line_end")).alias("span"))
    return render.sources(items, files, items).select(F.col("item_id").alias("doc_id"), "text")


@register(" SELECT CASE WHEN module_path = '' THEN 'tpch' ELSE module_path END AS module_path, module_path || ':' || chr(10) || chr(10) || string_agg('trait  ' || path || chr(10) || '    ' || signature, chr(10) || chr(10) ORDER BY path, item_id) AS lines FROM items WHERE kind = 'Trait' GROUP BY module_path")
def recursive_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.documented(_plain(_items(spark, sf_dir)).filter("kind = 'Trait'")).select("module_path", "lines")


@register(f""" SELECT item_id, '{{"path":"' || path || '","kind":"' || {_SHORT} || '","signature":"' || signature || '","summary":""' || CASE WHEN reexport_source IS NULL THEN '' ELSE ',"reexported_from":"' || reexport_source || '"' END || '}}' AS line FROM items WHERE docs = ''""")
def json_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.json_list(_plain(_items(spark, sf_dir)).filter("docs = ''"), "item_id")


# An index built from documentation JSON: a package for each region, a module for each nation, a struct with an
# inherent and a trait implementation for each supplier.

_GENERICS = '{"params":[],"where_predicates":[]}'
_METHOD = '{"function":{"sig":{"inputs":%s,"output":%s,"is_c_variadic":false},"generics":' + _GENERICS + ',"header":{"is_const":false,"is_unsafe":false,"is_async":false,"abi":"Rust"},"has_body":true}}'
_GET = _METHOD % ('[["self",{"borrowed_ref":{"lifetime":null,"is_mutable":false,"type":{"generic":"Self"}}}]]', '{"primitive":"u32"}')
_DEFAULT = _METHOD % ("[]", '{"generic":"Self"}')


def _documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """package, json."""
    region, nation, supplier = (corpus.read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    text = lambda c: F.col(c).cast("string")
    package = F.concat(F.lit("region_"), text("r_regionkey"))

    def item(key, name, inner, visibility="public", docs=""):
        return F.format_string('"%s":{"id":%s,"crate_id":0,"name":%s,"span":{"filename":"src/lib.rs","begin":[1,1],"end":[2,1]},"visibility":"' + visibility + '","docs":"' + docs + '","links":{},"attrs":[],"deprecation":null,"inner":%s}', key, key, name, inner)

    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    module = lambda ids: F.concat(F.lit('{"module":{"is_crate":false,"is_stripped":false,"items":['), ids, F.lit("]}}"))
    key = lambda base, c: (F.col(c) + base).cast("string")
    ids = lambda base, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.col(c) + base)), lambda x: x.cast("string")), ",")
    impl = lambda member, trait: F.concat(F.lit('{"impl":{"is_unsafe":false,"generics":' + _GENERICS + ',"provided_trait_methods":[],"trait":' + trait + ',"for":{"resolved_path":{"path":"S","id":'), key(1000, "s_suppkey"), F.lit(',"args":null}},"items":['), member, F.lit('],"is_negative":false,"is_synthetic":false,"blanket_impl":null}}'))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("package", package)
    sold = supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    struct = F.concat(F.lit('{"struct":{"kind":"unit","generics":' + _GENERICS + ',"impls":['), key(10_000_000, "s_suppkey"), F.lit(","), key(20_000_000, "s_suppkey"), F.lit("]}}"))
    null = F.lit("null")
    parts = [
        (places.groupBy("package").agg(ids(1, "n_nationkey").alias("ids")), item(F.lit("0"), quoted(F.col("package")), module(F.col("ids")))),
        (places.join(sold.groupBy("n_nationkey").agg(ids(1000, "s_suppkey").alias("ids")), "n_nationkey", "left").withColumn("ids", F.coalesce("ids", F.lit(""))), item(key(1, "n_nationkey"), quoted(F.col("n_name")), module(F.col("ids")))),
        (sold, item(key(1000, "s_suppkey"), quoted(F.col("s_name")), struct, docs="A supplier.")),
        (sold, item(key(10_000_000, "s_suppkey"), null, impl(key(30_000_000, "s_suppkey"), "null"), "default")),
        (sold, item(key(20_000_000, "s_suppkey"), null, impl(key(40_000_000, "s_suppkey"), '{"path":"Default","id":9,"args":null}'), "default")),
        (sold, item(key(30_000_000, "s_suppkey"), quoted(F.lit("get")), F.lit(_GET))),
        (sold, item(key(40_000_000, "s_suppkey"), quoted(F.lit("default")), F.lit(_DEFAULT), "default")),
    ]
    path = lambda k, kind, *names: F.concat(quoted(k), F.lit(':{"crate_id":0,"kind":"' + kind + '","path":['), F.concat_ws(",", *[quoted(n) for n in names]), F.lit("]}"))
    named = [(places.select("package").distinct(), path(F.lit("0"), "module", F.col("package"))), (places, path(key(1, "n_nationkey"), "module", F.col("package"), F.col("n_name"))), (sold, path(key(1000, "s_suppkey"), "struct", F.col("package"), F.col("n_name"), F.col("s_name")))]

    def joined(rows, name):
        one = None
        for df, entry in rows:
            part = df.select("package", entry.alias("e"))
            one = part if one is None else one.unionByName(part)
        return one.groupBy("package").agg(F.array_join(F.array_sort(F.collect_list("e")), ",").alias(name))

    both = joined(parts, "items").join(joined(named, "paths"), "package")
    return both.select("package", F.concat(F.lit('{"root":0,"crate_version":"1.0.0","includes_private":false,"format_version":57,"index":{'), "items", F.lit('},"paths":{'), "paths", F.lit('},"external_crates":{}}')).alias("json"))


_JSON_ITEMS = """WITH p AS (SELECT n_nationkey, n_name, 'region_' || r_regionkey AS package FROM nation JOIN region ON n_regionkey = r_regionkey), s AS (SELECT package, package || '::' || n_name || '::' || s_name AS path, s_name FROM supplier JOIN p ON s_nationkey = n_nationkey)"""


def _built(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    inputs = fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in ("region", "nation", "supplier")])
    return Store(spark).get(f"{sf_dir}|json", "built", lambda: build.build_index(materialize(_documentation(spark, sf_dir), "json")), inputs)


@register(_JSON_ITEMS + """ SELECT DISTINCT package, package AS path, 'Module' AS kind, 'pub mod ' || package AS signature, '' AS summary, true AS is_public FROM p UNION ALL SELECT package, package || '::' || n_name, 'Module', 'pub mod ' || n_name, '', true FROM p
UNION ALL SELECT package, path, 'Struct', 'pub struct ' || s_name, 'A supplier.', true FROM s UNION ALL SELECT package, path || '::get', 'Function', 'pub fn get(&self) -> u32', '', true FROM s UNION ALL SELECT package, path || '::default', 'Function', 'fn default() -> Self', '', true FROM s""", corpus_cte=False)
def index_json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)["items"].select("package", "path", "kind", "signature", "summary", "is_public")


@register(_JSON_ITEMS + """, e AS (SELECT package, package AS parent, package || '::' || n_name AS child, n_nationkey AS o FROM p UNION ALL SELECT s.package, regexp_replace(s.path, '::[^:]*$', ''), s.path, s_suppkey FROM s JOIN supplier USING (s_name) UNION ALL SELECT package, path, path || '::get', 0 FROM s)
SELECT package, parent, CAST(row_number() OVER (PARTITION BY package, parent ORDER BY o) - 1 AS INTEGER) AS pos, child FROM e""", corpus_cte=False)
def index_json_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _built(spark, sf_dir)
    items = made["items"].select("package", "item_id", "path")
    rows = made["children"].join(items.select("package", F.col("item_id").alias("parent_id"), F.col("path").alias("parent")), ["package", "parent_id"]).join(items.select("package", F.col("item_id").alias("child_id"), F.col("path").alias("child")), ["package", "child_id"])
    return rows.select("package", "parent", "pos", "child")


@register(_JSON_ITEMS + " SELECT package, path, 0 AS pos, 'Default' AS trait_path, false AS is_synthetic FROM s", corpus_cte=False)
def index_json_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _built(spark, sf_dir)
    return made["trait_impls"].join(made["items"].select("package", "item_id", "path"), ["package", "item_id"]).select("package", "path", "pos", "trait_path", "is_synthetic")
