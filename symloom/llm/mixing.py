"""Mixing sources to target weights by Pareto order sampling.

A source with target ``t`` and size ``S`` words takes each document ``floor(t / S)`` times for certain; the
rest of the target, ``owed`` words, is a sample with unequal probabilities. A document's inclusion
probability is proportional to its size, ``p = c * size``, with ``c`` such that the expected words are
``owed``; documents for which that is 1 or more are certain too, and the others share what is left. A
document gets the rank ``Q = (u / (1 - u)) / (p / (1 - p))`` for a uniform ``u`` drawn from its id, and the
smallest ranks are taken. The sample's size is fixed in words: documents follow in order of rank while
they fit in ``owed``. What is then open, less than the next document, goes to the one whose size is nearest to
it, or in order of rank to those that fit where all are much smaller; either halves it, until no document
brings the sum nearer.

Finding a cut never sorts a source in one task: words are summed in 4096 bins of the rank, then in
4096 bins within the bin where the sum crosses, and only that sliver is ordered.

Defined results: a null text has size 0; null ``source`` is a source of its own, last in order; a null
``doc_id`` draws by its text; repeated rows share their draw and are taken together, ties in rank go by id;
an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stages, arrow_map, texts, unit_key

CAP = 3
SEED = "mix-1"
_BITS = 52
_ORDER = "struct<key:bigint,id:bigint,t:bigint,size:bigint>"


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text), t (a hash of the text where there is no id)."""

    def work(cols):
        held = texts(cols["text"])
        marks = [0 if known else xxhash.xxh3_64_intdigest(x) - 2**63 for known, x in zip(cols["doc_id"].is_valid().to_pylist(), held, strict=True)]
        return {"doc_id": cols["doc_id"], "source": cols["source"], "size": [len(x.split()) for x in held], "t": marks}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")), "doc_id long, source string, size long, t long", work)


def ranked_sources(stages: Stages, sized: DataFrame) -> DataFrame:
    """source, sid (rank by code point, null last, from 0), source_size; ranks are dealt by range, not in one task."""
    spark = stages.spark
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stages.keep(sums.repartitionByRange(parts, F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "sources")
    before = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))  # one row a partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    return stages.keep(dealt.join(F.broadcast(before), "part").select("source", (F.col("first") + rank).alias("sid"), "source_size"), "ranked")


def targets(sources: DataFrame, weight, cap: int = CAP) -> DataFrame:
    """Adds ``target``: weight shares of all words, at most ``cap`` sizes each, the excess reshared by weight.

    Each round is one sum over the source table; the driver holds two numbers."""
    level, fixed, held = None, 0, -1
    sources = sources.withColumn("weight", weight)
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap * F.col("source_size")
        row = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, cap * F.col("source_size")).otherwise(0)).alias("fixed"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("free"), F.count(F.when(over, 1)).alias("n")).first()
        fixed, n = row["fixed"] or 0, row["n"]
        if n == held or not row["free"]:
            break
        level, held = ((row["all"] or 0) - fixed) / row["free"], n
    share = F.col("weight") * F.lit(float(level or 0.0))
    return sources.withColumn("target", F.when(share > cap * F.col("source_size"), (cap * F.col("source_size")).cast("double")).otherwise(share))


def inclusion(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sid, least (documents of this size and more are certain; null: none), rate (the others' probability a word), left (words owed beyond the certain ones).

    Works on the sizes that occur in a source. Sums are exact, so that reruns agree."""
    words, squares = F.col("n") * F.col("size"), (F.col("n") * F.col("size")).cast("decimal(38,0)") * F.col("size").cast("decimal(19,0)")
    sizes = sized.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = sizes.join(sources.filter("owed > 0").select(F.col("source").alias("_source"), "sid", "owed"), F.col("source").eqNullSafe(F.col("_source"))).select("sid", "owed", "size", words.alias("words"), squares.cast("decimal(38,0)").alias("squares"))
    down = Window.partitionBy("sid").orderBy(F.desc("size"))
    sizes = sizes.withColumn("left", F.col("owed") - F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("rest", F.sum("squares").over(down.rowsBetween(0, Window.unboundedFollowing)).cast("double"))
    sizes = sizes.withColumn("above", F.lag("size").over(down))
    # Going down the sizes, the first that is not certain given that all larger ones are.
    return sizes.filter(F.col("left") * F.col("size") < F.col("rest")).groupBy("sid").agg(F.max(F.struct("size", "above", (F.col("left") / F.col("rest")).alias("rate"), "left")).alias("x")).select("sid", F.col("x.above").alias("least"), F.col("x.rate").alias("rate"), F.col("x.left").alias("left"))


def mix(spark: SparkSession, docs: DataFrame, weight=None, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, probability (of the last copy) for every row of ``docs``."""
    stages = Stages(spark, "mix")
    weight = (F.col("sid") % 3 + 1) if weight is None else weight
    sized = stages.keep(word_sizes(docs), "sized")
    sources = stages.keep(targets(ranked_sources(stages, sized), weight, cap), "targets")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0)
    sources = sources.withColumn("whole", whole.cast("long")).withColumn("owed", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    rates = sources.join(inclusion(sized, sources), "sid", "left")
    rates = stages.keep(rates.select(F.col("source").alias("_source"), "sid", "source_size", "target", "whole", "least", "rate", F.coalesce("left", F.lit(0.0)).alias("owed")), "rates")
    rows = sized.join(rates, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    certain = F.coalesce(F.col("size") >= F.col("least"), F.lit(False)) & (F.col("size") > 0)
    u = unit_key(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("t").cast("string"))))
    p = F.col("rate") * F.col("size")
    rows = rows.withColumn("certain", certain).withColumn("p", F.when(~F.col("certain") & (p > 0), p))
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    rows = stages.keep(rows.withColumn("key", F.floor(q / (1 + q) * 2.0**_BITS).cast("long")), "keyed")

    order = F.struct("key", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "t", "size")
    sample = rows.filter("key IS NOT NULL").select("sid", "key", "size", order.alias("order"))
    state = rates.filter("owed > 0").select("sid", "owed", F.lit(0).cast("long").alias("spent"))
    first = _cut(stages, stages.keep(sample.join(state, "sid").select("sid", "key", "size", "order", F.col("owed").alias("open")), "sample"))
    cut = lambda open_: F.struct(open_.cast("double").alias("open"), F.col("last"))
    state = state.join(first, "sid", "left").select("sid", "owed", (F.col("spent") + F.coalesce("words", F.lit(0))).alias("spent"), F.when(F.col("last").isNotNull(), F.array(cut(F.lit(float("inf"))))).otherwise(F.array().cast(f"array<struct<open:double,last:{_ORDER}>>")).alias("cuts"), F.array().cast(f"array<{_ORDER}>").alias("extra"))
    taken = F.exists("cuts", lambda x: (F.col("size") <= x["open"]) & (F.col("order") <= x["last"])) | F.array_contains("extra", F.col("order"))
    gap = F.col("owed") - F.col("spent")
    while True:
        state = stages.keep(state, "state")
        rest = stages.keep(sample.join(state.filter(gap > 0), "sid").filter((F.col("size") < 2 * gap) & ~taken).select("sid", "key", "size", "order", gap.alias("open")), "rest")
        if rest.isEmpty():
            break
        near = rest.groupBy("sid").agg(F.min(F.struct(F.abs(F.col("size") - F.col("open")).alias("off"), F.col("order"))).alias("x"), F.min("size").alias("least"), F.first("open").alias("open"))
        one = stages.keep(near.filter((2 * F.col("x.off") < F.col("open")) | (F.col("least") > F.col("open"))).select("sid", F.col("x.order").alias("next")), "nearest")
        several = _cut(stages, rest.filter("size <= open").join(one, "sid", "left_anti"))
        state = state.join(one, "sid", "left").join(several, "sid", "left")
        spent = F.col("spent") + F.coalesce("next.size", "words", F.lit(0))
        state = state.select("sid", "owed", spent.alias("spent"), F.when(F.col("last").isNull(), F.col("cuts")).otherwise(F.array_append("cuts", cut(F.col("open")))).alias("cuts"), F.when(F.col("next").isNull(), F.col("extra")).otherwise(F.array_append("extra", F.col("next"))).alias("extra"))
    out = rows.withColumn("order", order).join(state.drop("owed", "spent"), "sid", "left")
    sampled = F.col("key").isNotNull() & taken
    copies = F.col("whole") + (F.col("certain") | F.coalesce(sampled, F.lit(False))).cast("long")
    chance = F.when(F.col("certain"), 1.0).otherwise(F.coalesce("p", F.lit(0.0)))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), chance.alias("probability"))


def _cut(stages: Stages, rows: DataFrame) -> DataFrame:
    """sid, open, last, words: for rows (sid, key, size, order, open), how far in order they fit in ``open`` and what they sum to."""
    first = _crossing(rows.withColumn("bin", F.shiftright("key", 40)).withColumn("spent", F.lit(0).cast("long")))
    inside = rows.join(first, "sid", "left").filter(F.col("at").isNotNull() & (F.shiftright("key", 40) == F.col("at"))).drop("at")
    second = stages.keep(_crossing(inside.withColumn("bin", F.shiftright("key", 28))), "crossing")
    inside = rows.join(second, "sid").filter(F.shiftright("key", 28) == F.col("at"))
    upto = F.sum("size").over(Window.partitionBy("sid").orderBy("order").rangeBetween(Window.unboundedPreceding, 0)) + F.col("spent")
    inside = inside.withColumn("upto", upto).filter(F.col("upto") <= F.col("open")).groupBy("sid").agg(F.max("order").alias("last_in"), F.max("upto").alias("upto"))
    # Where all fit there is no crossing: the last row of all.
    ends = rows.join(second, "sid", "left").filter(F.col("at").isNull() | (F.shiftright("key", 28) < F.col("at"))).groupBy("sid").agg(F.max("order").alias("last_before"), F.sum("size").alias("sum_before"))
    opened = rows.groupBy("sid").agg(F.first("open").alias("open"))
    out = opened.join(inside, "sid", "left").join(ends, "sid", "left")
    return out.select("sid", "open", F.coalesce("last_in", "last_before").alias("last"), F.coalesce("upto", "sum_before").alias("words")).filter("last IS NOT NULL")


def _crossing(rows: DataFrame) -> DataFrame:
    """sid, at (the bin in which the running sum passes ``open``), spent (words before that bin)."""
    bins = rows.groupBy("sid", "bin").agg(F.sum("size").alias("words"), F.first("open").alias("open"), F.first("spent").alias("spent"))
    run = F.sum("words").over(Window.partitionBy("sid").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.withColumn("upto", run + F.col("spent"))
    return bins.filter((F.col("upto") > F.col("open")) & (F.col("upto") - F.col("words") <= F.col("open"))).select("sid", F.col("bin").alias("at"), (F.col("upto") - F.col("words")).alias("spent"))
