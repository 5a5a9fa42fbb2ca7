"""Density clusters (DBSCAN) over a graph of grid cells.

A cell's side is eps / sqrt(d), so any two of its points are within eps: a cell with enough
points has core points only and is one node of the cluster graph. Other cells
hold few points; only these meet the points of neighbouring cells, and what is kept of a meeting is a
count for each node. Two full cells are linked if their nearest points are within eps; this is decided on boxes
that are halved where they leave it open, so no table has all pairs of two cells.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.components import connected_components
from lectern.sources.scratch import drop_written, written

#: More coordinates have too many neighbouring cells; longer vectors go through principal coordinates first.
MOST_DIMS = 4


def _squares(xs: list[Column]) -> Column:
    total = F.lit(0.0)
    for x in xs:
        total = total + x * x
    return total


def _distance(a: str, b: str, dims: int) -> Column:
    """Squared distance of two points."""
    return _squares([F.get(F.col(a), F.lit(i)) - F.get(F.col(b), F.lit(i)) for i in range(dims)])


def _boxes(points: DataFrame, dims: int, keys: list[str]) -> DataFrame:
    """Per key a point and the corners of the box around all points."""
    at = lambda i: F.get("v", F.lit(i))
    g = points.groupBy(*keys).agg(F.first("v").alias("one"), *[F.min(at(i)).alias(f"lo{i}") for i in range(dims)], *[F.max(at(i)).alias(f"hi{i}") for i in range(dims)])
    return g.select(*keys, "one", F.array(*[F.col(f"lo{i}") for i in range(dims)]).alias("lo"), F.array(*[F.col(f"hi{i}") for i in range(dims)]).alias("hi"))


def _linked_cells(full: DataFrame, side: float, eps: float, dims: int, shifts: Column) -> DataFrame:
    """(a, b): node pairs of full cells whose nearest points are within eps. ``full``: (node, cell, v)."""
    cells = full.select("node", "cell").distinct()
    near = cells.withColumn("s", F.explode(shifts)).select(F.col("node").alias("b"), F.zip_with("cell", "s", lambda x, y: x + y).alias("cell"))
    pairs = cells.select(F.col("node").alias("a"), "cell").join(near, "cell").where("a < b").select("a", "b")
    root = F.array(*[F.lit(0).cast("long") for _ in range(dims)])
    open_ = written(pairs.withColumn("sa", root).withColumn("sb", root))
    found, level, reach = None, 0, F.lit(eps * eps)
    while open_.take(1):
        width = side / 2**level
        sub = F.array(*[F.floor((F.get("v", F.lit(i)) - F.get("cell", F.lit(i)) * side) / width).cast("long") for i in range(dims)])
        if level == 0:
            sub = root
        asked = open_.select(F.col("a").alias("node")).union(open_.select(F.col("b").alias("node"))).distinct()
        boxes = written(_boxes(full.join(asked, "node").withColumn("sub", sub), dims, ["node", "sub"]))
        of = lambda end: boxes.select(F.col("node").alias(end), F.col("sub").alias(f"s{end}"), *[F.col(c).alias(f"{c}_{end}") for c in ("one", "lo", "hi")])
        j = open_.join(of("a"), ["a", "sa"]).join(of("b"), ["b", "sb"])
        get = lambda c, i: F.get(F.col(c), F.lit(i))
        gap = _squares([F.greatest(get("lo_a", i) - get("hi_b", i), get("lo_b", i) - get("hi_a", i), F.lit(0.0)) for i in range(dims)])
        points = (F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b"))
        state = F.when(_distance("one_a", "one_b", dims) <= reach, "linked").when((gap > reach) | points, "apart").otherwise("open")
        decided = written(j.select("a", "b", "sa", "sb", state.alias("state")))
        more = decided.where("state = 'linked'").select("a", "b").distinct()
        found = more if found is None else found.union(more)
        rest = decided.where("state = 'open'").join(more, ["a", "b"], "left_anti")
        halves = F.array(*[F.array(*[F.lit(h).cast("long") for h in hs]) for hs in product((0, 1), repeat=dims)])
        split = lambda c: F.explode(F.transform(halves, lambda h: F.zip_with(F.col(c), h, lambda x, y: 2 * x + y)))
        drop_written(open_)
        open_ = written(rest.select("a", "b", split("sa").alias("sa"), "sb").select("a", "b", "sa", split("sb").alias("sb")))
        drop_written(boxes)
        level += 1
    drop_written(open_)
    return pairs.limit(0) if found is None else found


def dbscan_topics(points: DataFrame, eps: float, min_samples: int, dims: int) -> DataFrame:
    """(id, cluster): density clusters of (id, v: ``dims`` doubles); -1 for noise, else the smallest core id of the cluster.

    A point within eps of ``min_samples`` points, itself included, is core; others take the smallest cluster of a
    core point within eps. Rows of one id are points each and take one cluster, the smallest. Rows without an id, or with a null or non-finite coordinate, are noise and no neighbours.
    """
    if not 1 <= dims <= MOST_DIMS:
        raise ValueError(f"dims must be 1 to {MOST_DIMS}")
    side, r = eps / math.sqrt(dims), math.ceil(math.sqrt(dims))
    # neighbours whose nearest corners are within eps
    near = [s for s in product(range(-r, r + 1), repeat=dims) if sum(max(abs(x) - 1, 0) ** 2 for x in s) <= dims]
    shifts = F.array(*[F.array(*[F.lit(x).cast("long") for x in s]) for s in near])
    whole = F.col("id").isNotNull() & F.col("v").isNotNull()
    for i in range(dims):
        whole = whole & F.coalesce(F.abs(F.get("v", F.lit(i))) < float("inf"), F.lit(False))
    cell = F.array(*[F.floor(F.get("v", F.lit(i)) / side).cast("long") for i in range(dims)])
    base = written(points.where(whole).select("id", "v", cell.alias("cell")))
    sizes = base.groupBy("cell").agg(F.count("*").alias("n"), F.min("id").alias("node"))
    placed = written(base.join(sizes, "cell").select("id", "v", "cell", "n", F.when(F.col("n") >= min_samples, F.col("node")).otherwise(F.col("id")).alias("node")))
    full, few = placed.where(F.col("n") >= min_samples), placed.where(F.col("n") < min_samples)
    asking = few.select(F.col("id").alias("p"), F.col("v").alias("pv"), F.explode(shifts).alias("s"), F.col("cell").alias("c"))
    asking = asking.select("p", "pv", F.zip_with("c", "s", lambda x, y: x + y).alias("cell"))
    met = asking.join(placed, "cell").where(_distance("pv", "v", dims) <= eps * eps)
    met = written(met.groupBy("p", "node").agg(F.count("*").alias("n"), F.max(F.col("n") >= min_samples).alias("full")))
    core = written(met.groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select(F.col("p").alias("node")))
    nodes = core.union(full.select("node").distinct())
    ends = met.where("full").select("p", "node").union(met.where("not full").select("p", "node").join(core, "node").select("p", "node"))
    ends = written(ends)
    links = ends.join(core.withColumnRenamed("node", "p"), "p").select(F.col("p").alias("a"), F.col("node").alias("b"))
    links = links.union(_linked_cells(full.select("node", "cell", "v"), side, eps, dims, shifts))
    label = written(nodes.join(connected_components(links).withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("cluster")))
    border = ends.join(label, "node").groupBy(F.col("p").alias("id")).agg(F.min("cluster").alias("near"))
    own = placed.select("id", "node").join(label, "node").groupBy("id").agg(F.min("cluster").alias("cluster"))
    out = points.select("id").join(own, "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("cluster", "near", F.lit(-1)).cast("long").alias("cluster"))
