"""Skeleton edges and outlines against plain tracers on random cells."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from fieldloom.operators import tracing

AROUND = [(dx, dz) for dz in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dz) != (0, 0)]


def plain_edges(cells: set[tuple[int, int]]) -> set[tuple]:
    near = {c: [(c[0] + dx, c[1] + dz) for dx, dz in AROUND if (c[0] + dx, c[1] + dz) in cells] for c in cells}
    order = lambda a, b: (a[1], a[0], b[1], b[0])
    out, walked = set(), set()

    def walk(a, b):
        way = [a, b]
        while len(near[way[-1]]) == 2 and way[-1] != a:
            way.append(next(n for n in near[way[-1]] if n != way[-2]))
        return way

    starts = [c for c in cells if len(near[c]) != 2]
    for a in starts:
        for b in near[a]:
            way = walk(a, b)
            walked.update(way)
            out.add(tuple(min(way, way[::-1], key=lambda w: order(w[0], w[1]))))
    for a in sorted(cells, key=lambda c: (c[1], c[0])):
        if len(near[a]) == 2 and a not in walked:
            way = walk(a, min(near[a], key=lambda c: (c[1], c[0])))
            walked.update(way)
            out.add(tuple(way))
    return out


def edges_of(df) -> set[tuple]:
    of = defaultdict(list)
    for r in df.collect():
        of[r.edge].append((r.seq, r.x, r.z))
    return {tuple(p[1:] for p in sorted(v)) for v in of.values()}


def some_cells(seed: int) -> set[tuple[int, int]]:
    rng = random.Random(seed)
    cells = {(rng.randrange(-12, 12), rng.randrange(-12, 12)) for _ in range(90)}
    cells |= {(x, 40) for x in range(30)} | {(5, z) for z in range(35, 46)}  # a long line with a crossing
    cells |= {(100 + round(9 * math.cos(i / 30)), round(9 * math.sin(i / 30))) for i in range(190)}
    return cells | {(200 + i, i) for i in range(40)} | {(300, 300)}


@pytest.mark.parametrize("seed", range(3))
def test_edges(spark, seed):
    cells = some_cells(seed)
    df = spark.createDataFrame([*cells, *list(cells)[:5]], "x int, z int").repartition(5)
    assert edges_of(tracing.traced(df)) == plain_edges(cells)


def test_a_diamond_is_one_closed_edge(spark):
    ring = [(0, 0), (1, 1), (2, 2), (1, 3), (0, 4), (-1, 3), (-2, 2), (-1, 1)]
    got = tracing.traced(spark.createDataFrame(ring, "x int, z int")).orderBy("seq").collect()
    assert [(r.x, r.z) for r in got] == [(0, 0), (-1, 1), (-2, 2), (-1, 3), (0, 4), (1, 3), (2, 2), (1, 1), (0, 0)] and all(r.closed for r in got)
    assert tracing.traced(spark.createDataFrame([], "x int, z int")).count() == 0


def test_classes(spark):
    line = [(x, 0) for x in range(30)]
    points = tracing.traced(spark.createDataFrame(line, "x int, z int"))
    of = lambda mapped: [(r.classification, round(r.novel, 3), r.length, r.overlaps) for r in tracing.classified(points, spark.createDataFrame(mapped, "x int, z int")).collect()]
    assert of([(90, 90)]) == [("image-visible-branch", 1.0, 29.0, False)]
    assert of([(0, 2)]) == [("extension", round(28 / 30, 3), 29.0, False)]
    assert of([(0, 0), (29, 1)]) == [("connector", round(24 / 30, 3), 29.0, False)]
    assert of([(x, 0) for x in range(18)]) == [("extension", round(10 / 30, 3), 29.0, True)]
    assert of([(x, 0) for x in range(24)]) == []


def plain_rings(cells: set[tuple[int, int]]) -> set[tuple]:
    sides = {(c, i) for c in cells for i, s in enumerate(tracing.SIDES) if (c[0] + s[2][0], c[1] + s[2][1]) not in cells}
    begin = lambda e: (e[0][0] + tracing.SIDES[e[1]][0][0], e[0][1] + tracing.SIDES[e[1]][0][1])
    end = lambda e: (e[0][0] + tracing.SIDES[e[1]][1][0], e[0][1] + tracing.SIDES[e[1]][1][1])
    at, out, used = defaultdict(list), set(), set()
    for e in sides:
        at[begin(e)].append(e)
    for e in sorted(sides, key=lambda e: (begin(e)[1], begin(e)[0], e[1])):
        if e in used:
            continue
        ring = [e]
        while True:
            nexts = at[end(ring[-1])]
            nxt = next((n for n in nexts if n[0] == ring[-1][0]), nexts[0])
            if nxt == e:
                break
            ring.append(nxt)
        used.update(ring)
        area = sum(begin(s)[0] * end(s)[1] - end(s)[0] * begin(s)[1] for s in ring) / 2
        out.add((area, tuple(begin(s) for i, s in enumerate(ring) if s[1] != ring[i - 1][1])))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rings(spark, seed):
    rng = random.Random(seed)
    cells = {(x, z) for x in range(-9, 10) for z in range(-9, 10) if rng.random() < 0.35 + 0.2 * seed}
    df = spark.createDataFrame(list(cells), "x int, z int").repartition(5)
    got = tracing.rings(df).collect()
    of = defaultdict(list)
    for r in got:
        of[(r.region, r.ring, r.area)].append((r.seq, (int(r.x), int(r.z))))
    assert {(k[2], tuple(p for _, p in sorted(v))) for k, v in of.items()} == plain_rings(cells)
    assert sum(k[2] for k in of) == len(cells)
    for region in {k[0] for k in of}:
        mine = sorted((k[1], k[2]) for k in of if k[0] == region)
        assert [n for n, _ in mine] == list(range(len(mine))) and mine[0][1] > 0 and all(a < 0 for _, a in mine[1:])


def test_rings_in_metres(spark):
    got = tracing.rings(spark.createDataFrame([(0, 0), (1, 0)], "x int, z int"), 0.5, 10.0, 20.0).orderBy("seq").collect()
    assert [(r.x, r.z) for r in got] == [(10.0, 20.0), (11.0, 20.0), (11.0, 20.5), (10.0, 20.5)] and {r.area for r in got} == {0.5}
    assert tracing.rings(spark.createDataFrame([], "x int, z int")).count() == 0
