"""Components of links within candidate lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop_table, materialise
from lectern.operators.components import connected_components


def linked_components(lists: DataFrame, bound: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components of all verified pairs that share a list, without emitting all pairs of a list.

    ``lists``: (g, id, rank, ...), a written table; the rest are attributes that
    ``bound("x", "y")`` may use, a necessary condition of a link (x.id and y.id
    share the list). ``verify`` turns (a, b) into the pairs that are links.

    First every member is tried with its list's hub, the member of lowest rank;
    that is linear. Pairs that are in one component by then cannot change the
    result, so from then on only lists of several components count. While their
    pairs are many and become fewer, another hub is tried, one outside the
    list's largest component. At last all pairs of different components that
    meet the bound are tried: no link between components is lost.
    """
    rest = [c for c in lists.columns if c not in ("g", "id", "rank")]
    first = F.min(F.struct("rank", "id", *rest))

    def star(members: DataFrame, hubs: DataFrame) -> DataFrame:
        pairs = members.alias("y").join(hubs.alias("x"), F.col("x.g") == F.col("y.g")).where((F.col("x.id") != F.col("y.id")) & bound("x", "y"))
        if "component" in members.columns:
            pairs = pairs.where("x.component <> y.component")
        return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()

    tried = materialise(star(lists, lists.groupBy("g").agg(first.alias("h")).select("g", "h.*")), "star")
    links = materialise(verify(tried), "links")
    done, last = [tried, links], None
    while True:
        comp = materialise(connected_components(links), "comp")
        named = lists.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        sizes = named.groupBy("g", "component").agg(F.count("*").alias("c"))
        mixed = sizes.groupBy("g").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.max(F.struct("c", "component")).alias("most")).where("m * m > sq")
        left = materialise(named.join(mixed.select("g", "m", "sq", F.col("most.component").alias("largest")), "g"), "mixed")
        done += [comp, left]
        rows, pairs = left.agg(F.count("*"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / F.col("m") / 2)).first()
        if not rows:
            done.remove(comp)
            out = comp
            break
        end = pairs <= 4 * rows or (last is not None and pairs > 0.75 * last)
        last = pairs
        members = left.select(*lists.columns, "component")
        if end:
            both = members.alias("x").join(members.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.component") < F.col("y.component")) & bound("x", "y"))
            pairs = both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        else:
            hubs = left.where("component <> largest").groupBy("g").agg(F.min(F.struct("rank", "id", *rest, "component")).alias("h")).select("g", "h.*")
            pairs = star(members, hubs)
        pairs = materialise(pairs.join(tried, ["a", "b"], "left_anti"), "star")
        more = materialise(verify(pairs), "links")
        done += [pairs, more]
        tried, links = tried.union(pairs), links.union(more)
        if end:
            out = connected_components(links)
            break
    for table in done:
        drop_table(table)
    return out
