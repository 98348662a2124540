"""Near-duplicates: MinHash bands for candidates, sequential Bayesian verification, exact confirmation.

1. A pass over the documents hashes word shingles, names each set by a digest (its node), and takes
   ``BANDS`` band keys of ``ROWS`` minima and a second signature of ``PROBES`` minima that the bands do not
   use. A pair at the threshold misses every band with probability ``(1 - 0.8**ROWS)**BANDS``, below 1e-5.
2. Equal sets are one node, whatever their number.
3. In a band bucket of up to ``SMALL`` nodes all pairs are candidates. In a larger one a pivot, the node
   that shares most buckets, meets all others; what links is one component from then on.
4. A larger bucket that still holds several components is split by what its members differ in from the
   pivot: two sets x and y link only if their differences from the pivot share at least
   ``(a(x) + a(y)) / 2`` elements, ``a`` being the difference's size less the set's share of the distance
   allowed. So each difference is put in order, elements that few others hold first, and only members that
   share an element early enough in that order are candidates. Elements that one component alone holds come
   first of all, and those that over half of the members hold come last: both stay inside the member's row.
   No link is lost, and a group of near copies whose edits differ costs rows in proportion to the edits, not pairs.
5. A candidate's second signatures are compared in batches of ``STEP``; it goes once the posterior
   probability that its similarity reaches the threshold (uniform prior) falls below ``MISS``.
6. Survivors are confirmed on the full shingle sets, as 64-bit hashes.

Defined results: a text without words (or null) has no shingles and is linked with nothing; a text
shorter than a shingle is one shingle; rows that share a ``doc_id`` are one document, which links whatever
any of its texts links; a null id counts as the largest, is never a shared id, and yields null as its component
only where no other row is in it; an empty table gives an empty result; other columns are ignored.
Texts are hashed whole.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, arrow_map, texts
from .graph import components

ROWS, BANDS = 6, 40
PROBES, STEP = 64, 16
MISS = 1e-6
PERCENT = 80
SMALL = 8
NULL_ID = 2**63 - 1


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    size = min(n, width)
    acc = np.full(n - size + 1, size, dtype=np.uint64)
    for j in range(size):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : n - size + 1 + j]
    acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(acc ^ (acc >> np.uint64(32)))


def node_of(found: np.ndarray) -> int:
    """Name of a shingle set, a signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63


def minima(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest value of each linear permutation of the upper 32 bits."""
    low = np.full(len(a), 2**32 - 1, dtype=np.uint32)
    upper = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(upper), 1024):
        np.minimum(low, (a[:, None] * upper[None, at : at + 1024] + b[:, None]).min(axis=1), out=low)
    return low


def signer(width: int):
    random = np.random.default_rng(20240229)
    count = ROWS * BANDS + PROBES
    a = random.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = random.integers(0, 2**32, count, dtype=np.uint32)

    def work(cols):
        sizes, nodes, keys, probes = [], [], [], []
        for text in texts(cols["text"]):
            found = shingles(text, width)
            sizes.append(len(found))
            if not len(found):
                nodes.append(None), keys.append(None), probes.append(None)
                continue
            low = minima(found, a, b)
            nodes.append(node_of(found))
            bands = low[: ROWS * BANDS].reshape(BANDS, ROWS)
            keys.append([xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - 2**63 for i, row in enumerate(bands)])
            probes.append(low[ROWS * BANDS :].tobytes())
        return {"id": cols["id"], "t": cols["t"], "n": sizes, "node": nodes, "bands": keys, "probes": probes}

    return work


def least_matches(percent: int) -> dict[int, int]:
    """After n compared minima, the fewest matches with which P(similarity >= threshold) is still MISS.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum."""
    t, out = percent / 100, {}
    for n in range(STEP, PROBES + 1, STEP):
        tail, m = 0.0, -1
        while m < n:
            tail += comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)
            if tail >= MISS:
                break
            m += 1
        out[n] = m + 1
    return out


def _plausible(percent: int):
    need = least_matches(percent)

    def work(cols):
        left, right = (np.frombuffer(b"".join(cols[c].to_pylist()), dtype=np.uint32).reshape(-1, PROBES) for c in ("pa", "pb"))
        alive = np.arange(len(left))
        hits = np.zeros(len(left), dtype=int)
        for n, least in need.items():
            hits[alive] += (left[alive, n - STEP : n] == right[alive, n - STEP : n]).sum(axis=1)
            alive = alive[hits[alive] >= least]
        kept = pa.array(alive)
        return {"a": cols["a"].take(kept), "b": cols["b"].take(kept)} if len(alive) else None

    return work


def _confirmed(percent: int):
    def work(cols):
        ok = []
        for i, (x, y) in enumerate(zip(cols["sa"].to_pylist(), cols["sb"].to_pylist(), strict=True)):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            if 100 * shared >= percent * (len(both) - shared):
                ok.append(i)
        kept = pa.array(ok, type=pa.int64())
        return {"a": cols["a"].take(kept), "b": cols["b"].take(kept)} if ok else None

    return work


def _differences(percent: int):
    """Of a node and its pivot (sets as bytes): elements in one set only, ``a`` and how many of the difference's elements in order can be the first that it shares with a partner it links."""
    lo, hi = 100 - percent, 100 + percent

    def work(cols):
        out = {"pivot": cols["pivot"], "node": cols["node"], "comp": cols["comp"], "n": [], "s": [], "a": [], "most": [], "elements": []}
        for p, x in zip(cols["sp"].to_pylist(), cols["sx"].to_pylist(), strict=True):
            p, x = np.frombuffer(p, dtype=np.uint64), np.frombuffer(x, dtype=np.uint64)
            apart = np.setxor1d(p, x, assume_unique=True)
            n, s = len(x), len(apart)
            a = hi * s - lo * n
            if a <= lo * len(p):  # linked with the pivot: partners that are not have a > lo * len(p)
                least = -(-(a + lo * len(p) + 1) // (2 * hi))
            else:  # a partner has at most 100/percent as many shingles, and must itself hold what is shared
                least = -(-(percent * a - 100 * lo * n) // (percent * hi))
            out["n"].append(n), out["s"].append(s), out["a"].append(a)
            out["most"].append(max(0, s - max(1, least) + 1))
            out["elements"].append(apart.view(np.int64))
        return out

    return work


def _held(stages: Stages, apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements that members of several components of a pivot hold: (pivot, e, held) of those that at most half of its members do, and (pivot, common), the others as one list, rarest first and at most twice as long as the mean difference."""
    sizes = apart.groupBy("pivot").agg(F.count("*").alias("members"))
    one = apart.select("pivot", "comp", F.explode("elements").alias("e"))
    several = one.groupBy("pivot", "e").agg(F.count("*").alias("held"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    held = stages.keep(several.join(sizes, "pivot").select("pivot", "e", "held", (2 * F.col("held") > F.col("members")).alias("most")), "held")
    order = F.transform(F.array_sort(F.collect_list(F.struct("held", "e"))), lambda x: x["e"])
    return held.filter("NOT most").drop("most"), held.filter("most").groupBy("pivot").agg(order.alias("common"))


def _places(stages: Stages, apart: DataFrame) -> DataFrame:
    """key, node, n, s, a, pos: where members stand that may link one of another component."""
    rare, common = _held(stages, apart)
    none = F.array().cast("array<long>")
    apart = apart.join(common, "pivot", "left").withColumn("common", F.coalesce("common", none))
    order = apart.select("pivot", "node", F.explode(F.array_except("elements", "common")).alias("e")).join(rare, ["pivot", "e"]).groupBy("pivot", "node").agg(F.array_sort(F.collect_list(F.struct("held", "e"))).alias("rare"))
    last = apart.select("pivot", "node", "n", "s", "a", "most", F.array_intersect("common", "elements").alias("last"))
    placed = last.join(order, ["pivot", "node"], "left").withColumn("shared", F.concat(F.coalesce(F.transform("rare", lambda x: x["e"]), none), "last"))
    placed = placed.withColumn("alone", F.col("s") - F.size("shared")).filter("most > alone")  # elements that no other component holds come first, and need no place
    placed = placed.select("pivot", "node", "n", "s", "a", "alone", F.posexplode(F.slice("shared", F.lit(1), F.col("most") - F.col("alone"))).alias("at", "e"))
    return placed.select(F.xxhash64("pivot", "e").alias("key"), "node", "n", "s", "a", (F.col("alone") + F.col("at")).alias("pos"))


def _split(stages: Stages, members: DataFrame, bags: DataFrame, percent: int) -> DataFrame:
    """key, node, n, s, a, pos: the places of (pivot, node, comp) members under the rare elements of their differences."""
    both = members.join(bags.select(F.col("node").alias("pivot"), F.col("bag").alias("sp")), "pivot").join(bags.select("node", F.col("bag").alias("sx")), "node")
    apart = stages.keep(arrow_map(both.select("pivot", "node", "comp", "sp", "sx"), "pivot long, node long, comp long, n int, s int, a long, most int, elements array<long>", _differences(percent)), "apart")
    return _places(stages, apart.filter("most > 0"))


def _beside(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds ``comp``, the smallest node of the component."""
    if labels is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _open(stages: Stages, rows: DataFrame) -> DataFrame:
    """Rows (key, node, n, comp, ...) of keys with several components, with the key's size and pivot; None where there are none."""
    rows = stages.keep(rows, "labelled")
    rows = rows.join(rows.groupBy("node").agg(F.count("*").alias("keys")), "node")
    best = F.max(F.struct("keys", "node", "n", "comp", *[c for c in ("s", "a", "pos") if c in rows.columns])).alias("p")
    keys = stages.keep(rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), best).filter("lo < hi").select("key", "size", "p"), "keys")
    return None if keys.isEmpty() else stages.keep(rows.drop("keys").join(keys, "key"), "open")


def _alike(x: str, y: str, percent: int):
    """Sizes that a link allows."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.col(f"{x}comp") != F.col(f"{y}comp"))


def _early(x: str, y: str, percent: int):
    """Whether the shared element stands early enough in both differences for the overlap that a link needs."""
    left = [F.col(f"{k}s") - F.col(f"{k}pos") for k in (x, y)]
    return 2 * (100 + percent) * F.least(*left) >= F.col(f"{x}a") + F.col(f"{y}a")


def _ends(x: str, y: str):
    return F.least(f"{x}node", f"{y}node").alias("a"), F.greatest(f"{x}node", f"{y}node").alias("b")


class Verifier:
    """Candidates (a, b) to links: batches of the second signature, then the full sets."""

    def __init__(self, stages: Stages, probes: DataFrame, bags: DataFrame, percent: int):
        self.stages, self.probes, self.bags, self.percent = stages, probes, bags, percent

    def links(self, candidates: DataFrame) -> DataFrame:
        pairs = self.stages.keep(candidates.distinct(), "pairs")
        probed = pairs.join(self.probes.select(F.col("node").alias("a"), F.col("probes").alias("pa")), "a").join(self.probes.select(F.col("node").alias("b"), F.col("probes").alias("pb")), "b")
        likely = self.stages.keep(arrow_map(probed, "a long, b long", _plausible(self.percent)), "likely")
        full = likely.join(self.bags.select(F.col("node").alias("a"), F.col("bag").alias("sa")), "a").join(self.bags.select(F.col("node").alias("b"), F.col("bag").alias("sb")), "b")
        return self.stages.keep(arrow_map(full, "a long, b long", _confirmed(self.percent)), "sure")


def _linked(stages: Stages, live: DataFrame, links: DataFrame, check: Verifier) -> DataFrame:
    """id, comp of the nodes (key, node, n) of band buckets, given ``links`` known beforehand."""
    percent = check.percent

    def joined(links, labels):
        return components(stages, links if labels is None else links.unionByName(labels.select(F.col("id").alias("a"), F.col("comp").alias("b"))))

    labels = None if links.isEmpty() else joined(links, None)
    met = _open(stages, _beside(live, labels))
    if met is None:
        return labels
    few = met.filter(F.col("size") <= SMALL).select("key", "node", "n", "comp")
    l, r = few.alias("l"), few.alias("r")
    pairs = l.join(r, F.col("l.key") == F.col("r.key")).filter((F.col("l.node") < F.col("r.node")) & _alike("l.", "r.", percent)).select(*_ends("l.", "r."))
    star = met.filter(F.col("size") > SMALL)
    labels = joined(check.links(pairs.unionByName(star.filter(_alike("", "p.", percent)).select(*_ends("", "p.")))), labels)

    rest = _beside(star.filter("node <> p.node").select("key", "node", F.col("p.node").alias("pivot")), labels)
    rest = stages.keep(rest, "rest")
    split = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    members = stages.keep(rest.join(split, "key").select("pivot", "node", "comp").distinct(), "members")
    if members.isEmpty():
        return labels
    places = stages.keep(_split(stages, members, check.bags, percent), "places")
    met = _open(stages, _beside(places, labels))
    if met is None:
        return labels
    large = met.filter(F.col("size") > SMALL)
    labels = joined(check.links(large.filter(_alike("", "p.", percent) & _early("", "p.", percent)).select(*_ends("", "p."))), labels)
    met = _open(stages, _beside(places, labels))
    if met is None:
        return labels
    # Every pair of components has a node outside the pivot's.
    l, r = met.filter(F.col("comp") != F.col("p.comp")).alias("l"), met.alias("r")
    other = (F.col("r.comp") == F.col("r.p.comp")) | (F.col("l.node") < F.col("r.node"))
    pairs = l.join(r, F.col("l.key") == F.col("r.key")).filter(other & _alike("l.", "r.", percent) & _early("l.", "r.", percent)).select(*_ends("l.", "r."))
    return joined(check.links(pairs), labels)


def classes(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    stages = Stages(spark, "neardup")
    text = F.col("text").cast("string")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    signed = stages.keep(arrow_map(rows, "id long, t long, n int, node long, bands array<long>, probes binary", signer(width)), "signed")
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    found = signed.withColumn("place", place).filter("n > 0")
    nodes = stages.keep(found.groupBy("node").agg(F.min("id").alias("id"), F.min(F.struct("id", "t", "place")).alias("r")), "nodes")
    standing = stages.keep(found.select("place", "node", "n", "bands", "probes").join(nodes.select(F.col("r.place").alias("place")), "place"), "standing")  # a row of the staged table for each node

    keyed = standing.select("node", "n", F.explode("bands").alias("key"))
    shared = stages.keep(keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key"), "shared")
    live = stages.keep(keyed.join(shared, "key"), "live")
    wanted = live.select("node").distinct().join(nodes, "node").select("node", F.col("r.id").alias("id"), F.col("r.t").alias("t"))

    def bag(cols):
        out = [shingles(t, width) for t in texts(cols["text"])]
        kept = pa.array([i for i, (x, node) in enumerate(zip(out, cols["node"].to_pylist(), strict=True)) if node_of(x) == node], pa.int64())
        return {"node": cols["node"].take(kept), "bag": [out[i].tobytes() for i in kept.to_pylist()]} if len(kept) else None

    bags = stages.keep(arrow_map(rows.join(wanted, ["id", "t"]), "node long, bag binary", bag).dropDuplicates(["node"]), "bags")
    several = found.filter(F.col("id") != NULL_ID).groupBy("id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("id", "lo")
    same = stages.keep(found.join(several, "id").filter("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct(), "same")
    labels = _linked(stages, live, same, Verifier(stages, standing.select("node", "probes"), bags, percent))

    whole = _beside(nodes.select("node", "id"), labels)
    least = whole.groupBy("comp").agg(F.min("id").alias("component"))
    whole = stages.keep(whole.join(least, "comp").select("node", "component"), "components")
    out = signed.select("id", "n", "node").join(whole, "node", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.nullif("component", F.lit(NULL_ID)).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def dedupe(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id (rows that share the kept id, and rows without id, all stay)."""
    gone = Stages(spark, "copies").keep(classes(spark, docs, width, percent).filter("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
