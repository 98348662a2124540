"""Exact top-k inner products with an M-tree.

Vectors are floored to integers, ``floor(256 * x)``. Largest inner product becomes nearest neighbour
by adding one axis: with ``M`` at least every norm, ``x' = (x, sqrt(M^2 - |x|^2))`` and ``q' = (q, 0)``
give ``|x' - q'|^2 = M^2 + |q|^2 - 2 x.q``. An M-tree of fixed pages is built over each run of
``chunk`` rows of a task: a node holds a routing vector, its distance to the parent's routing vector
and a covering radius. A search visits nodes by their lower bound; a child whose stored parent distance
already proves it too far costs no distance computation. Scores are computed in doubles where these are
exact, else in 64-bit integers, else in Python's; bounds give way by a part of the lengths in question,
so rounding loses nothing. Vectors too long for a double's squares are held against every query instead.

Trees are built once and written; the queries travel, in blocks of about ``block`` however many there
are, and each task sends its best k of each query.

Defined results: a vector that is null, empty, or holds a null or a non-finite component takes no part, as
a null id; a score that does not fit a long is an error; vectors meet those of their own length only;
queries that share an id and a vector are one query, and those that share the id only are queries of their
own; repeated rows with the query's id are not its candidates, other repeats count one by one; ties go
to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stages

PAGE = 128
FANOUT = 16
CHUNK = 16384
BLOCK = 4096
SLACK = 1e-3
LONGEST = 2.0**500
_INTS = [(2**15, np.int16), (2**31, np.int32), (2**62, np.int64)]


def compact(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them, Python's beyond 64 bits."""
    most = float(np.abs(x).max(initial=0.0))
    for bound, kind in _INTS:
        if most < bound:
            return x.astype(kind)
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def exactly(own: np.ndarray, most: float):
    """(vector, product): how rows of whole numbers up to ``most`` meet ``own`` without rounding."""
    reach = most * float(np.abs(own).max(initial=0)) * len(own)
    if reach < 2.0**53:
        return own.astype(np.float64), lambda points, q: points.astype(np.float64, copy=False) @ q
    if reach < 2.0**62:
        return own.astype(np.int64), lambda points, q: points.astype(np.int64) @ q
    return np.array([int(v) for v in own.tolist()], dtype=object), _in_python


def _in_python(points: np.ndarray, own: np.ndarray) -> np.ndarray:
    out = np.array([[int(v) for v in row] for row in points.tolist()], dtype=object).reshape(points.shape) @ own
    if any(abs(v) >= 2**63 for v in out):
        raise OverflowError("an inner product does not fit a long")
    return out.astype(np.int64)


class Node:
    __slots__ = ("ids", "kids", "pivot", "pivots", "points", "radii", "radius", "spread", "to_parent")


class MTree:
    """Pages of at most ``PAGE`` vectors under routing nodes of at most ``FANOUT`` children."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.exact = ids, vectors
        self.computed, self.root = 0, None
        plain = vectors.astype(np.float64)
        self.most = float(np.abs(plain).max(initial=0.0))
        if self.most < LONGEST:
            norms = (plain**2).sum(axis=1)
            self.top = float(norms.max(initial=0.0))
            self.points = np.concatenate([plain, np.sqrt(self.top - norms)[:, None]], axis=1)
            self.root = self._build(np.arange(len(ids)))
            del self.points

    def packed(self) -> bytes:
        """The tree as plain arrays, to be written."""

        def of(node):
            kids = None if node.kids is None else ([of(k) for k in node.kids], node.pivots, node.radii, node.to_parent)
            return node.pivot, node.radius, kids, None if kids else (node.ids, node.points, node.spread)

        return pickle.dumps((self.most, (self.ids, self.exact) if self.root is None else (self.top, of(self.root))))

    @classmethod
    def unpacked(cls, data) -> MTree:
        tree, (most, (a, b)) = cls.__new__(cls), pickle.loads(data)

        def of(part):
            node = Node()
            node.pivot, node.radius, kids, leaf = part
            node.kids = None
            if kids:
                node.kids, node.pivots, node.radii, node.to_parent = [of(k) for k in kids[0]], *kids[1:]
            else:
                node.ids, node.points, node.spread = leaf
            return node

        tree.most, tree.computed, tree.root = most, 0, None
        if isinstance(a, float):
            tree.top, tree.root = a, of(b)
        else:
            tree.ids, tree.exact = a, b
        return tree

    def _build(self, rows: np.ndarray) -> Node:
        node = Node()
        node.pivot = self.points[rows].mean(axis=0)
        spread = np.sqrt(((self.points[rows] - node.pivot) ** 2).sum(axis=1))
        node.radius = float(spread.max(initial=0.0))
        node.kids = None
        if len(rows) <= PAGE or node.radius == 0.0:
            order = np.lexsort((self.ids[rows], spread))
            node.spread, node.ids = spread[order], self.ids[rows[order]]
            node.points = self.exact[rows[order]]
            return node
        node.kids = [self._build(g) for g in self._split(rows, spread)]
        node.pivots = np.array([k.pivot for k in node.kids])
        node.radii = np.array([k.radius for k in node.kids])
        node.to_parent = np.sqrt(((node.pivots - node.pivot) ** 2).sum(axis=1))
        return node

    def _split(self, rows: np.ndarray, spread: np.ndarray) -> list[np.ndarray]:
        """Farthest-first seeds, each row to its nearest; rows that cannot be told apart are halved."""
        points, seeds = self.points[rows], [int(spread.argmax())]
        near = ((points - points[seeds[0]]) ** 2).sum(axis=1)
        owner = np.zeros(len(rows), dtype=int)
        while len(seeds) < min(FANOUT, -(-len(rows) // PAGE) + 1) and near.max() > 0:
            seeds.append(int(near.argmax()))
            d = ((points - points[seeds[-1]]) ** 2).sum(axis=1)
            owner[d < near] = len(seeds) - 1
            near = np.minimum(near, d)
        groups = [g for g in (rows[owner == i] for i in range(len(seeds))) if len(g)]
        return groups if len(groups) > 1 else [rows[: len(rows) // 2], rows[len(rows) // 2 :]]

    def search(self, query: np.ndarray, skip: int, best: list[tuple], k: int) -> None:
        """Improves ``best``, a heap of at most k (score, -id)."""
        own, product = exactly(query, self.most)
        q = np.append(query.astype(np.float64), 0.0)
        if self.root is None or float(np.abs(q).max()) >= LONGEST:
            for ids, points in [(self.ids, self.exact)] if self.root is None else self._leaves(self.root):
                self._offer(ids, product(points, own), skip, best, k)
            return
        lift = self.top + float((q**2).sum())
        give = SLACK + 1e-6 * lift**0.5

        def reach() -> float:
            """Distance beyond which nothing can enter ``best``."""
            return np.inf if len(best) < k else max(0.0, lift - 2.0 * best[0][0]) ** 0.5 + give

        limit, turn = reach(), 0
        dist = float(np.sqrt(((q - self.root.pivot) ** 2).sum()))
        self.computed += 1
        queue = [(max(0.0, dist - self.root.radius), 0, dist, self.root)]
        while queue:
            bound, _, dist, node = heapq.heappop(queue)
            if bound > limit:
                return
            if node.kids is not None:
                near = np.flatnonzero(np.abs(dist - node.to_parent) - node.radii <= limit)
                away = node.pivots[near] - q
                far = np.sqrt(np.einsum("ij,ij->i", away, away))
                self.computed += len(near)
                low = np.maximum(bound, far - node.radii[near])
                for i, lo, d in zip(near.tolist(), low.tolist(), far.tolist(), strict=True):
                    if lo <= limit:
                        turn += 1
                        heapq.heappush(queue, (lo, turn, d, node.kids[i]))
                continue
            a, b = np.searchsorted(node.spread, dist - limit, "left"), np.searchsorted(node.spread, dist + limit, "right")
            if a >= b:
                continue
            self.computed += int(b - a)
            if self.most < 2.0**26:  # doubles multiply faster; converted when first met
                node.points = node.points.astype(np.float64, copy=False)
            self._offer(node.ids[a:b], product(node.points[a:b], own), skip, best, k)
            limit = reach()

    def _leaves(self, node: Node):
        if node.kids is None:
            yield node.ids, node.points
        for kid in node.kids or ():
            yield from self._leaves(kid)

    @staticmethod
    def _offer(ids: np.ndarray, scores: np.ndarray, skip: int, best: list[tuple], k: int) -> None:
        pick = np.flatnonzero(scores >= best[0][0]) if len(best) == k else np.arange(len(scores))
        for s, i in sorted(zip(scores[pick].tolist(), (-ids[pick]).tolist(), strict=True), reverse=True):
            one = (int(s), i)
            if -i == skip:
                continue
            if len(best) < k:
                heapq.heappush(best, one)
            elif one > best[0]:
                heapq.heapreplace(best, one)
            else:
                break


def _parse(ids, vectors):
    """Ids and integer vectors that take part, by length: {length: (ids, matrix)}."""
    found: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids.to_pylist(), vectors.to_pylist(), strict=True):
        if i is None or not v or None in v or not np.isfinite(v).all():
            continue
        x = np.floor(256.0 * np.asarray(v, dtype=np.float64))
        if not np.isfinite(x).all():
            raise OverflowError("a component does not fit a double when scaled")
        own = found.setdefault(len(v), ([], []))
        own[0].append(i)
        own[1].append(x)
    return {n: (np.array(a, dtype=np.int64), np.array(b)) for n, (a, b) in found.items()}


def _planter(chunk: int):
    """Map over a task's batches: gather ``chunk`` rows of a length and write their tree."""

    def run(batches):
        held: dict[int, list] = {}

        def planted(n):
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(n), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([MTree(ids, compact(rows)).packed()], pa.binary())], names=["n", "tree"])

        for batch in batches:
            for n, own in _parse(batch.column(0), batch.column(1)).items():
                held.setdefault(n, []).append(own)
                if sum(len(x[0]) for x in held[n]) >= chunk:
                    yield planted(n)
        for n in list(held):
            yield planted(n)

    return run


def _searcher(queries, k: int):
    """Map over a task's trees: search all queries in each, keep the best k."""

    def run(batches):
        blocks = queries.value
        best: dict[int, list] = {}
        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if n in blocks:
                    tree = MTree.unpacked(blob.as_buffer())
                    for at, (qid, q) in enumerate(zip(*blocks[n], strict=True)):
                        tree.search(q, int(qid), best.setdefault((n, at), []), k)
        out = [(int(blocks[n][0][at]), n << 32 | at, -neg, score) for (n, at), heap in best.items() for score, neg in heap]
        for lo in range(0, len(out), 50_000):
            part = list(zip(*out[lo : lo + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in part], names=["query_id", "asked", "vec_id", "score"])

    return run


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query (vec_id, embedding)."""
    stages = Stages(spark, "mtree")
    plain = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    trees = stages.keep(vectors.select(*plain).mapInArrow(_planter(chunk), "n int, tree binary"), "trees")
    asked = stages.keep(queries.select(*plain).filter("vec_id IS NOT NULL").distinct(), "asked")
    blocks = max(1, -(-asked.count() // block))
    found = None
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == b).toArrow()  # about ``block`` rows
        sent = spark.sparkContext.broadcast({n: (ids, compact(rows)) for n, (ids, rows) in _parse(mine.column(0), mine.column(1)).items()})
        part = trees.mapInArrow(_searcher(sent, k), "query_id long, asked long, vec_id long, score long").withColumn("block", F.lit(b))
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id", "block", "asked").orderBy(F.desc("score"), "vec_id")  # at most k rows a task and query
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
