"""Documentation JSON as tables: one row per file, cut into the texts of its items, each of them read with VARIANT functions.

An item is a variant of its own: a variant carries the names of all keys below it, and those of a whole
index are as many as its items, so items taken out of the index's variant would each carry them all.

Nothing is inferred: unknown fields are ignored, absent ones are null. The parser refuses documents nested
some hundred levels deep; ``parse_deep`` reads one such document in Python, outside the index build."""

from __future__ import annotations

import json
import sys
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """package, json: a whole file a row, named by the file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("package"), F.col("value").alias("json"))


def entries(docs: DataFrame, section: str) -> DataFrame:
    """package, id, text (JSON) of the members of a section, an object by id. An id that stands twice in one is an error."""
    held = F.from_json("json", f"{section} MAP<STRING, STRING>", {"mode": "FAILFAST"})[section]
    return docs.select("package", F.explode(F.transform_keys(held, lambda id, _: id)).alias("id", "text"))


def items(docs: DataFrame) -> DataFrame:
    """package, id, item (variant), tag, body (variant) of every indexed item."""
    return docs.sparkSession.sql(
        """SELECT package, id, item, k.key AS tag, k.value AS body
           FROM (SELECT package, id, parse_json(text) AS item FROM {entries}),
           LATERAL variant_explode_outer(variant_get(item, '$.inner', 'variant')) k""",
        entries=entries(docs, "index"),
    )


def paths(docs: DataFrame) -> DataFrame:
    """package, id, path, kind of the summary table."""
    return entries(docs, "paths").select(
        "package", "id", F.array_join(F.variant_get(F.parse_json("text"), "$.path", "array<string>"), "::").alias("path"), F.variant_get(F.parse_json("text"), "$.kind", "string").alias("kind")
    )


def roots(docs: DataFrame) -> DataFrame:
    return docs.select("package", F.get_json_object("json", "$.root").alias("root"))


def parse_deep(text: str) -> dict:
    """A document nested without bound, parsed in a thread with a stack to match."""
    out: list = []

    def work():
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(1_000_000)
        try:
            out.append(json.loads(text))
        finally:
            sys.setrecursionlimit(limit)

    size = threading.stack_size(512 * 1024 * 1024)
    try:
        thread = threading.Thread(target=work)
        thread.start()
        thread.join()
    finally:
        threading.stack_size(size)
    if not out:
        raise ValueError("not a JSON document")
    return out[0]
