"""Exact top-k search by inner product: a ball tree per shard, branch and bound, a shared kth score.

Vectors are dealt to shards by space: a small tree of hyperplanes, fitted on a
bounded sample, routes every vector to a leaf, and a leaf's vectors to shards of
about SHARD_ROWS. Each shard's ball tree is built once and written. A leaf, like
a node of a tree, bounds the score of what it holds by ``q.c + |q| r``.

Queries go to the leaves in waves, by falling bound: the best leaf, a few more,
all others. Before each wave a query's kth score over all shards so far is
shared; leaves whose bound does not reach it are left out, and in a shard nodes
are taken by falling bound until the best one left is under the kth score. So a
vector is moved once to be built in, once a wave within its tree, and a query as
often as leaves may hold a better score.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import drop_table, materialise

SCALE = 1024
#: Vectors in a leaf of a ball tree, about, and in a shard.
LEAF, SHARD_ROWS = 64, 16_384
#: Leaves of the routing tree at most (they are broadcast), and vectors that it is fitted on, about.
ROUTES, SAMPLE_ROWS = 1_024, 20_000
#: Ranks of the leaves, by bound, at which the waves begin.
WAVES = (0, 1, 4)
#: Components up to this size make inner products that doubles hold exactly (64 of them: 2**52).
EXACT = 1 << 23
LONG = (-(1 << 63), (1 << 63) - 1)


def scaled_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): components floor(1024 x) as doubles; rows that are null or hold null or non-finite components are left out."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(finite, F.lit(False))).select("vec_id", v.alias("v"))


class BallTree:
    """Centres, radii and children of the nodes; leaves hold slices of ``order``."""

    def __init__(self, x: np.ndarray):
        self.x, self.order, self.nodes = x, np.arange(len(x)), []
        if len(x):
            self._build(0, len(x))

    def _build(self, lo: int, hi: int) -> None:
        todo = [(lo, hi, -1, 0)]
        while todo:
            lo, hi, up, side = todo.pop()
            part = self.order[lo:hi]
            rows = self.x[part]
            c = rows.mean(axis=0)
            r = float(np.sqrt(((rows - c) ** 2).sum(1).max())) * (1 + 1e-9)
            at = len(self.nodes)
            self.nodes.append([c, r, lo, hi, -1, -1])
            if up >= 0:
                self.nodes[up][4 + side] = at
            if hi - lo > LEAF and r > 0:
                far = rows[((rows - c) ** 2).sum(1).argmax()]
                other = rows[((rows - far) ** 2).sum(1).argmax()]
                along = rows @ (other - far)
                mid = (hi - lo) // 2
                self.order[lo:hi] = part[np.argpartition(along, mid)]
                todo += [(lo, lo + mid, at, 0), (lo + mid, hi, at, 1)]

    def finish(self) -> "BallTree":
        self.centres = np.array([n[0] for n in self.nodes])
        self.radii = np.array([n[1] for n in self.nodes])
        self.leaf = np.array([n[4] < 0 for n in self.nodes], bool)
        return self


def exact_scores(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond what doubles hold exactly, Python integers, kept within a long."""
    if len(rows) and max(np.abs(rows).max(initial=0), np.abs(q).max(initial=0)) * np.sqrt(len(q)) >= EXACT * 8:
        big = [int(v) for v in q]
        return np.array([min(max(sum(int(a) * b for a, b in zip(r, big)), LONG[0]), LONG[1]) for r in rows], np.int64)
    return np.rint(rows @ q).astype(np.int64)


def search(tree: BallTree, ids: np.ndarray, q: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
    """(score, vec_id) of the best k in the shard that reach ``floor``."""
    if not tree.nodes:
        return []
    norm = float(np.sqrt(q @ q))
    bounds = bound(tree.centres, tree.radii, q[None], np.array([norm]))[0]
    best: list[tuple[int, int]] = []  # min-heap of (score, -vec_id)
    open_ = [(-bounds[0], 0)]
    while open_:
        at_most, at = heapq.heappop(open_)
        kth = best[0][0] if len(best) == k else None
        low = max(x for x in (kth, floor, LONG[0]) if x is not None)
        if -at_most < low:
            break
        if tree.leaf[at]:
            part = tree.order[tree.nodes[at][2] : tree.nodes[at][3]]
            for s, i in zip(exact_scores(tree.x[part], q).tolist(), ids[part].tolist()):
                if i != own and s >= low:
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
        else:
            for child in tree.nodes[at][4:6]:
                heapq.heappush(open_, (-bounds[child], child))
    return [(s, -i) for s, i in best]


def bound(centres: np.ndarray, radii: np.ndarray, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """For each query the largest inner product that each ball may hold, and a little more for rounding."""
    slack = 1e-6 * (1.0 + norms * float(np.abs(centres).max(initial=0)))
    return q @ centres.T + norms[:, None] * radii + slack[:, None]


class Routes:
    """A tree of hyperplanes over vectors of one length; its leaves are numbers from 0. Vectors of other lengths have a leaf for their length, below 0."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.length = sample.shape[1]
        self.planes: list[tuple[np.ndarray, float, int, int]] = []  # normal, threshold, below, above: planes, or ~leaf
        self.centres: list[np.ndarray] = []
        self.root = self._fit(sample, max(0, (leaves - 1).bit_length()))

    def _fit(self, x: np.ndarray, depth: int) -> int:
        c = x.mean(axis=0) if len(x) else np.zeros(self.length)
        far = x[((x - c) ** 2).sum(1).argmax()] if len(x) else c
        other = x[((x - far) ** 2).sum(1).argmax()] if len(x) else c
        along = x @ (other - far)
        cut = float(np.median(along)) if len(x) else 0.0
        above = along > cut
        if depth == 0 or len(x) < 8 or above.all() or not above.any():
            self.centres.append(c)
            return ~(len(self.centres) - 1)
        at = len(self.planes)
        self.planes.append((other - far, cut, 0, 0))
        below, over = self._fit(x[~above], depth - 1), self._fit(x[above], depth - 1)
        self.planes[at] = (other - far, cut, below, over)
        return at

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root)
        while (at >= 0).any():
            for p in np.unique(at[at >= 0]):
                normal, cut, below, over = self.planes[p]
                rows = np.flatnonzero(at == p)
                at[rows] = np.where(x[rows] @ normal > cut, over, below)
        return ~at


def _route(routes: Routes, batches):
    """(vec_id, v, leaf, dist): dist is the distance from the leaf's centre, or from zero."""
    centres = np.array(routes.centres)
    for b in batches:
        vectors = b.column("v").to_pylist()
        leaf, dist = np.array([-1 - len(v) for v in vectors], np.int64), np.zeros(len(vectors))
        same = [i for i, v in enumerate(vectors) if len(v) == routes.length]
        if same:
            x = np.array([vectors[i] for i in same], np.float64).reshape(len(same), -1)
            leaf[same] = routes.leaves(x)
            dist[same] = np.sqrt(((x - centres[leaf[same]]) ** 2).sum(1)) * (1 + 1e-9)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(leaf), pa.array(dist)], names=["vec_id", "v", "leaf", "dist"])


def _built(key: tuple, rows: pa.Table) -> pa.Table:
    """The ball tree of a shard, as one row."""
    x = np.array(rows.column("v").to_pylist(), np.float64).reshape(rows.num_rows, -1)
    blob = pickle.dumps((BallTree(x).finish(), rows.column("vec_id").to_numpy()))
    return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([blob], pa.binary())})


def _visits(routes: Routes, balls, lo: int, hi: int | None, batches):
    """Queries with each leaf of rank ``lo`` to ``hi`` by bound that may hold a score of their floor."""
    names = ["leaf", "query_id", "v", "floor"]
    leaves, centres, radii = balls.value
    for b in batches:
        vectors = b.column("v").to_pylist()
        of, out = [], []
        same = np.array([i for i, v in enumerate(vectors) if len(v) == routes.length], np.int64)
        if lo == 0:
            odd = [i for i, v in enumerate(vectors) if len(v) != routes.length]
            of, out = [np.array(odd, np.int64)], [np.array([-1 - len(vectors[i]) for i in odd], np.int64)]
        if len(same) and len(leaves):
            q = np.array([vectors[i] for i in same], np.float64).reshape(len(same), -1)
            bounds = bound(centres, radii, q, np.sqrt((q * q).sum(1)))
            floor = b.column("floor").to_pylist()
            floor = np.array([-np.inf if floor[i] is None else floor[i] for i in same], np.float64)
            order = np.argsort(-bounds, axis=1, kind="stable")[:, lo:hi]
            row, place = np.nonzero(np.take_along_axis(bounds, order, 1) >= floor[:, None])
            of.append(same[row])
            out.append(leaves[order[row, place]])
        if of:
            of = np.concatenate(of)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), *(b.column(c).take(pa.array(of)) for c in names[1:])], names=names)


def _searched(k: int, batches):
    """Each shard's tree comes before its queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    shard, tree = None, None
    for b in batches:
        out = ([], [], [])
        for leaf, part, blob, q, v, floor in zip(*(b.column(c).to_pylist() for c in ("leaf", "part", "tree", "query_id", "v", "floor"))):
            if blob is not None:
                shard, tree = (leaf, part), pickle.loads(blob)
            elif shard == (leaf, part):
                for s, i in search(*tree, np.array(v, np.float64), q, k, floor):
                    for c, x in zip(out, (q, i, s)):
                        c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(embeddings: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row, ties to the smaller vec_id.

    ``is_query`` is a condition on vec_id. A query is no candidate of its own.
    Vectors that are null or hold null or non-finite components take no part;
    vectors of unlike length do not meet; rows that repeat a vec_id count once
    (the first by components); a score beyond a long is given as the nearest
    long; other columns are not read; an empty table gives an empty one. The
    routing tree is fitted on about SAMPLE_ROWS vectors, those of least hash.
    """
    spark = embeddings.sparkSession
    vectors = scaled_vectors(embeddings).groupBy("vec_id").agg(F.min("v").alias("v"))
    vectors = materialise(vectors, "vectors")
    n = vectors.count()
    most = int(-(1 << 63) + min(1.0, SAMPLE_ROWS / max(n, 1)) * ((1 << 64) - 1025))
    sample = vectors.where(F.xxhash64("vec_id") <= most).select("v").toArrow().column("v").to_pylist()
    length = Counter(map(len, sample)).most_common(1)[0][0] if sample else 0
    alike = [v for v in sample if len(v) == length]
    routes = Routes(np.array(alike, np.float64).reshape(len(alike), length), min(ROUTES, -(-n // SHARD_ROWS) or 1))
    routed = vectors.mapInArrow(partial(_route, routes), "vec_id long, v array<double>, leaf long, dist double")
    routed = materialise(routed, "routed")
    leaves = materialise(routed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("dist").alias("radius")), "leaves")
    known = leaves.where("leaf >= 0").orderBy("leaf").collect()  # ROUTES at most
    at = [r.leaf for r in known]
    balls = spark.sparkContext.broadcast((np.array(at, np.int64), np.array([routes.centres[i] for i in at], np.float64).reshape(len(at), length), np.array([r.radius for r in known], np.float64)))
    parts = leaves.select("leaf", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("parts"))
    shards = routed.join(parts, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "v")
    trees = materialise(shards.groupBy("leaf", "part").applyInArrow(_built, "leaf long, part int, tree binary"), "trees")
    drop_table(routed)
    queries = vectors.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v")
    found = None
    for lo, hi in zip(WAVES, [*WAVES[1:], None]):
        if found is None:
            asked = queries.withColumn("floor", F.lit(None).cast("long"))
        else:
            kth = _best(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
            asked = queries.join(kth, "query_id", "left").select("query_id", "v", "floor")
        visits = asked.mapInArrow(partial(_visits, routes, balls, lo, hi), "leaf long, query_id long, v array<double>, floor long")
        visits = visits.join(parts, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("tree"), "query_id", "v", "floor")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("query_id", "long"), ("v", "array<double>"), ("floor", "long"))]
        dealt = trees.select("leaf", "part", "tree", *none).union(visits).repartition("leaf", "part")
        dealt = dealt.sortWithinPartitions("leaf", "part", F.col("query_id").asc_nulls_first())
        wave = materialise(dealt.mapInArrow(partial(_searched, k), "query_id long, vec_id long, score long"), "found")
        found = wave if found is None else found.union(wave)
    drop_table(trees)
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 10
"""
