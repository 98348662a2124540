"""The corpus pipeline: five of the operators of ``symloom.llm`` in turn over ``documents``.

Each stage takes all that its predecessor kept, is written as Parquet in the shared folder and read
again, so a lost executor costs a part of one stage. All but the last return the columns of
``documents``; the last returns the mix: doc_id, source, size, source_size, target, copies, taken.
Empty tables give empty results; rows without id pass the filters, as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import decontaminate, langid, linededup, mixing, neardup
from symloom.llm.common import Stages, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language."""
    return langid.keep_known(spark, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs; ``n_chars`` follows the text."""
    cut = linededup.drop_lines(spark, docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return cut.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return neardup.dedupe(spark, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing.mix(spark, docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("mix_sources", mix_sources)]

#: Trained and hashed stages cannot be told in SQL; tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages, docs = Stages(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stages.keep(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
