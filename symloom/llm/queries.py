"""The registered queries of the operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classlm, decontaminate, langid, linededup, mixing, mtree, neardup, pii, suffixdedup, urlfilter
from .common import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(spark, table(spark, sf_dir, "documents"), width=2)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = linededup.drop_lines(spark, docs)
    return cut.select("doc_id", F.col("_total").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = langid.document_rows(docs).unionByName(langid.page_rows(table(spark, sf_dir, "pages")))
    return langid.identify(spark, rows, langid.fit(docs))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score(spark, table(spark, sf_dir, "documents"))


#: The tables hold no filter lists and no fetch times: both follow from md5 of the address, by the same rule in SQL.
FIRST_DAY, DAYS = 19723, 366


def list_events(pages: DataFrame) -> DataFrame:
    """Dated list events over all hosts, domains and first path segments of ``pages``."""
    host, segment = urlfilter.host_of(F.col("url")), F.regexp_extract("url", urlfilter.SEGMENT, 1)
    labels = F.split(host, r"\.")
    keys = pages.filter(host.isNotNull()).select(F.explode(F.array(F.struct(F.lit("host").alias("kind"), host.alias("key")), F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, -2, 2), ".").alias("key")), F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), segment).alias("key")))).alias("k")).filter(F.size(F.split("k.key", r"\.")) > 1).select("k.*").distinct()
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "kind", "key")), 1, 8), 16, 10).cast("long")
    keys = keys.withColumn("h", h)
    add = F.lit(FIRST_DAY) + F.floor(F.col("h") / 4) % 300
    gone = add + 20 + F.floor(F.col("h") / 1201) % 120

    def event(when, name, action, day):
        return F.when(when, F.struct(F.lit(name).alias("list"), F.lit(action).alias("action"), day.cast("int").alias("day")))

    made = F.array(event(F.col("h") % 4 == 0, "block", "add", add), event(F.col("h") % 4 == 0, "block", "remove", gone), event(F.col("h") % 8 == 0, "block", "add", gone + 60), event(F.col("h") % 10 == 1, "allow", "add", F.lit(FIRST_DAY) + F.col("h") % 100))
    return keys.select("kind", "key", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("e")).select("e.list", "kind", "key", "e.action", "e.day")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.select("page_id", "url", (F.lit(FIRST_DAY) + F.pmod(F.col("page_id") * 37, F.lit(DAYS))).cast("int").alias("day"))
    return urlfilter.evaluate(captures, list_events(pages), FIRST_DAY + DAYS)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digest(suffixdedup.cut_repeats(spark, table(spark, sf_dir, "documents")))


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = pii.detect(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return hits.select("doc_id", *counts, F.sha2(pii.label(F.col("base")), 256).alias("base_sha256"), pii.label(F.concat("base", "added")).alias("spans"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mtree.top_k(spark, vectors, vectors.filter(F.col("vec_id") % 50 == 0))


OP4_SQL = f"""
WITH p AS (SELECT page_id, url, CAST({FIRST_DAY} + (page_id * 37) % {DAYS} AS INTEGER) AS day, nullif(lower(regexp_extract(url, '{urlfilter.HOST}', 1)), '') AS host, regexp_extract(url, '{urlfilter.SEGMENT}', 1) AS segment FROM pages),
k0 AS (SELECT 'host' AS kind, host AS key FROM p UNION SELECT 'domain', array_to_string(string_split(host, '.')[-2:], '.') FROM p UNION SELECT 'prefix', host || '/' || segment FROM p),
k AS (SELECT kind, key, CAST('0x' || substr(md5(kind || ':' || key), 1, 8) AS BIGINT) AS h FROM k0 WHERE key LIKE '%.%'),
e AS (SELECT 'block' AS list, kind, key, false AS ends, {FIRST_DAY} + (h // 4) % 300 AS day FROM k WHERE h % 4 = 0
UNION ALL SELECT 'block', kind, key, true, {FIRST_DAY} + (h // 4) % 300 + 20 + (h // 1201) % 120 FROM k WHERE h % 4 = 0
UNION ALL SELECT 'block', kind, key, false, {FIRST_DAY} + (h // 4) % 300 + 80 + (h // 1201) % 120 FROM k WHERE h % 8 = 0
UNION ALL SELECT 'allow', kind, key, false, {FIRST_DAY} + h % 100 FROM k WHERE h % 10 = 1),
s AS (SELECT *, coalesce(lead(day) OVER (PARTITION BY list, kind, key ORDER BY day), 1073741824) AS until FROM e),
asked AS (SELECT page_id, url, day, 'host' AS kind, host AS key, 2 AS rank FROM p UNION ALL SELECT page_id, url, day, 'prefix', host || '/' || segment, 3 FROM p
UNION ALL SELECT page_id, url, day, 'domain', array_to_string(string_split(host, '.')[i:], '.'), 1 FROM (SELECT *, unnest(range(1, len(string_split(host, '.')))) AS i FROM p)),
a AS (SELECT asked.*, s.list, row_number() OVER (PARTITION BY page_id, asked.url, asked.day ORDER BY rank DESC, s.list = 'allow' DESC) AS n, count(*) OVER (PARTITION BY page_id, asked.url, asked.day) AS n_active
FROM asked JOIN s ON s.kind = asked.kind AND s.key = asked.key AND NOT s.ends AND s.day <= asked.day AND asked.day < s.until)
SELECT p.page_id, p.url, p.host, p.day, CAST(1 AS BIGINT) AS n_rows, CAST(coalesce(a.n_active, 0) AS BIGINT) AS n_active, a.kind, a.list, coalesce(a.list = 'allow', true) AS kept
FROM p LEFT JOIN a ON a.n = 1 AND a.page_id = p.page_id AND a.url = p.url AND a.day = p.day
"""

OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

#: What SQL can tell of op3: sizes and targets. tests/llm/test_mixing.py holds the query against it.
OP3_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s0),
s2 AS (SELECT *, sid % 3 + 1 AS w, sum(source_size) OVER () AS total, 3 * source_size / (sid % 3 + 1) AS r FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY r, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER (ORDER BY r DESC, sid DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS l FROM s2),
lv AS (SELECT l FROM s3 WHERE l <= r ORDER BY r, sid LIMIT 1),
s AS (SELECT source, sid, source_size, CASE WHEN w * lv.l > 3 * source_size THEN 3.0 * source_size ELSE w * lv.l END AS target FROM s3, lv)
SELECT d.doc_id, d.source, d.size, s.source_size, CAST(s.target AS DOUBLE) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_minhash_near_dedup": op1_minhash_near_dedup, "op2_decontaminate": op2_decontaminate, "op3_mix_sources": op3_mix_sources, "op4_url_filters": op4_url_filters, "op5_suffix_dedup": op5_suffix_dedup, "op6_pii_spans": op6_pii_spans, "op7_top_k": op7_top_k, "op8_line_dedup": op8_line_dedup, "op9_language_id": op9_language_id, "op10_class_lm": op10_class_lm}
ORACLE_SQL: dict[str, str] = {"op4_url_filters": OP4_SQL, "op7_top_k": OP7_SQL}
