"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lectern.sources.scratch import drop_written, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) longs -> (id, component), component the smallest id that links reach; ids without a link are absent.

    Alternates the large-star and small-star steps of the two-phase algorithm
    (Kiveris et al. 2014) until the edge set is a set of stars, which no round
    changes. Neighbourhood minima are aggregates (combined before the shuffle)
    joined back to the edges, so a hub with very many links is no single task's
    work. Each round is a written table: lineage stays short and a lost executor
    costs one round. Rows with a null end or equal ends are no links; repeated
    rows are harmless.
    """
    e, state = _counted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while state[0]:
        # large star: every larger neighbour of u moves to the smallest of u's neighbourhood
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the smaller neighbours of u, and u, move to their smallest
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v"))
        last, at = e, state
        e, state = _counted(small.where("u <> v").distinct())
        drop_written(last)
        if state == at:
            break
    out = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return out.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, with their number and a sum of their hashes, taken as they are written."""
    seen = Observation()
    table = written(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
    return table, (seen.get["n"], seen.get["h"])
