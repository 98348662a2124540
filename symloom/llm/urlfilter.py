"""URL filters by a temporal join with dated lists.

List events (add or remove, on a day) become validity intervals: each event holds until the next one
of its entry. A capture is looked up under its host, the parent domains of the host and the first
segment of its path, as of the day it was fetched. Intervals are cut at fixed slices of ``SLICE`` days,
so the join is an equi-join on (key, slice) in which a hot key spreads over time, and the adaptive
skew join splits what is left. Of the active entries the most specific decides (prefix, host, domain);
an allow entry wins over a block entry of the same kind.

Defined results: a null or malformed address has no key and is kept; a null fetch day meets no entry;
repeated captures are one row with their number; events without key or day are void; of two events of
one entry on one day the removal holds; empty lists keep everything; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 30
FOREVER = 2**30
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"
RANK = {"prefix": 3, "host": 2, "domain": 1}


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def intervals(events: DataFrame) -> DataFrame:
    """list, kind, key, since, until (day numbers, end exclusive) from events (list, kind, key, action, day)."""
    events = events.filter(F.col("key").isNotNull() & F.col("day").isNotNull())
    events = events.groupBy("list", "kind", "key", "day").agg(F.max(F.col("action") == "remove").alias("ends"))
    later = F.lead("day").over(Window.partitionBy("list", "kind", "key").orderBy("day"))
    spans = events.withColumn("until", F.coalesce(later, F.lit(FOREVER))).filter(~F.col("ends"))
    return spans.select("list", "kind", "key", F.col("day").alias("since"), "until")


def lookups(host: Column, segment: Column) -> Column:
    """Every (kind, key) under which a capture may be listed."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key")), F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), segment).alias("key")))
    return F.concat(own, F.when(F.size(labels) > 1, parents).otherwise(F.array().cast("array<struct<kind:string,key:string>>")))


def evaluate(captures: DataFrame, events: DataFrame, last_day: int | None = None) -> DataFrame:
    """captures (page_id, url, day) -> page_id, url, host, day, n_rows, n_active, kind, list, kept.

    ``last_day`` bounds how far open intervals are cut into slices; by default the latest capture's."""
    seen = captures.groupBy("page_id", "url", "day").agg(F.count("*").alias("n_rows"))
    seen = seen.withColumn("host", host_of(F.col("url"))).withColumn("segment", F.regexp_extract("url", SEGMENT, 1))
    if last_day is None:
        last_day = captures.agg(F.max("day")).first()[0] or 0
    spans = intervals(events).filter(F.col("since") <= last_day)
    last = F.floor(F.least(F.col("until") - 1, F.lit(last_day)) / SLICE).cast("int")
    cut = spans.withColumn("slice", F.explode(F.sequence(F.floor(F.col("since") / SLICE).cast("int"), last)))
    asked = seen.filter(F.col("host").isNotNull() & F.col("day").isNotNull()).select("page_id", "url", "day", F.explode(lookups(F.col("host"), F.col("segment"))).alias("k"))
    asked = asked.select("page_id", "url", "day", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"), F.floor(F.col("day") / SLICE).cast("int").alias("slice"))
    active = asked.join(cut, ["kind", "key", "slice"]).filter((F.col("since") <= F.col("day")) & (F.col("day") < F.col("until")))
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    best = F.max(F.struct(F.element_at(rank, F.col("kind")).alias("rank"), (F.col("list") == "allow").alias("allow"), F.col("kind").alias("kind"), F.col("list").alias("list")))
    ruled = active.groupBy("page_id", "url", "day").agg(F.count("*").alias("n_active"), best.alias("best"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("page_id", "url", "day")]
    out = seen.alias("s").join(ruled.alias("r"), same, "left")
    return out.select("s.page_id", "s.url", "s.host", "s.day", "s.n_rows", F.coalesce("r.n_active", F.lit(0)).cast("long").alias("n_active"), F.col("r.best.kind").alias("kind"), F.col("r.best.list").alias("list"), F.coalesce(F.col("r.best.allow"), F.lit(True)).alias("kept"))
