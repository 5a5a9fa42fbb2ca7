"""DBSCAN against brute force, and its tables against the size of a dense cell."""

import math
import random

import pytest

from lectern.operators import density


def plain(points, eps, least):
    ids = sorted(points)
    near = {a: [b for b in ids if sum((x - y) ** 2 for x, y in zip(points[a], points[b])) <= eps * eps] for a in ids}
    core = {a for a in ids if len(near[a]) >= least}
    cluster = {}
    for a in ids:
        if a in core and a not in cluster:
            todo = [a]
            cluster[a] = a
            while todo:
                for b in near[todo.pop()]:
                    if b in core and b not in cluster:
                        cluster[b] = a
                        todo.append(b)
    return {a: cluster.get(a, min([cluster[b] for b in near[a] if b in core], default=-1)) for a in ids}


@pytest.mark.parametrize("dims, least, seed", [(1, 3, 1), (2, 4, 2), (2, 1, 3), (3, 5, 4)])
def test_equals_brute_force(spark, dims, least, seed):
    r = random.Random(seed)
    points = {i: tuple(r.gauss(r.choice([0, 3, 3.9]), 0.35) for _ in range(dims)) for i in range(250)}
    points |= {1000 + i: tuple([5.0 + i * 0.5] + [1.0] * (dims - 1)) for i in range(8)}  # at distance eps exactly
    points |= {2000 + i: points[i] for i in range(60)}
    df = spark.createDataFrame([(k, list(v)) for k, v in points.items()], "id long, v array<double>")
    got = {x.id: x.cluster for x in density.dbscan_topics(df, 0.5, least, dims).collect()}
    assert got == plain(points, 0.5, least)


def test_full_cells_that_nearly_touch(spark):
    """Gaps just under and just over eps between dense lines, which boxes alone cannot decide."""
    points, n = {}, 0
    for gap, y0 in ((0.999, 0.0), (1.001, 10.0)):
        for k in range(40):
            for x in (0.0, gap):
                points[n] = (x, y0 + k * 0.01)
                n += 1
    df = spark.createDataFrame([(k, list(v)) for k, v in points.items()], "id long, v array<double>")
    got = {x.id: x.cluster for x in density.dbscan_topics(df, 1.0, 5, 2).collect()}
    assert got == plain(points, 1.0, 5) and len(set(got.values())) == 3


def test_rows_of_a_dense_cell_are_linear(spark, monkeypatch):
    seen = []
    keep = density.written

    def counted(df, name="table"):
        out = keep(df, name)
        seen.append(out.count())
        return out

    monkeypatch.setattr(density, "written", counted)
    sizes = []
    for n in (300, 1200):
        seen.clear()
        r = random.Random(n)
        rows = [(i, [r.random() * 0.3, r.random() * 0.3]) for i in range(n)] + [(n + i, [0.5 + r.random() * 0.3, 0.1]) for i in range(n)]
        density.dbscan_topics(spark.createDataFrame(rows, "id long, v array<double>"), 0.5, 4, 2).collect()
        sizes.append(sum(seen))
    assert sizes[1] < 6 * sizes[0]


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [math.nan, 0.0]), (None, [0.0, 0.0]), (5, [1e9, -1e9])]
    got = sorted((x.id is None, x.id, x.cluster) for x in density.dbscan_topics(spark.createDataFrame(rows, "id long, v array<double>"), 0.5, 2, 2).collect() if x.id is not None)
    assert [(i, c) for _, i, c in got] == [(1, 1), (1, 1), (2, -1), (3, -1), (4, -1), (5, -1)]
    assert density.dbscan_topics(spark.createDataFrame([], "id long, v array<double>"), 0.5, 2, 2).count() == 0
