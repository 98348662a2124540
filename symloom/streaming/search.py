"""Search over a stream of index snapshots. Beyond the batch engine: stateless, so it needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.operators import search as S
from symloom.operators.index import derive


def hits(spark: SparkSession, folder: str, schema: str, query: str) -> DataFrame:
    """Scored symbol rows (package, path, kind, signature, score) of files as they arrive."""
    rows = derive(spark.readStream.schema(schema).parquet(folder))
    return rows.withColumn("score", S.score(query)).filter("score > 0").select("package", "path", "kind", "signature", "score")
