"""Operators against brute force and on odd inputs."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.functions import geometry, numbers, text
from fieldloom.operators import graphs, raster, spatial, windows


def test_half_up(spark):
    got = spark.createDataFrame([(-2.5,), (2.5,), (0.05,), (None,)], "v double").select(numbers.half_up(F.col("v")).alias("r")).collect()
    assert [r.r for r in got] == [-2.0, 3.0, 0.0, None]


def test_number_coercions(spark):
    rows = spark.createDataFrame([("12.5 MB",), ("3 kb",), ("x",), (None,), ("",)], "t string")
    got = rows.select(numbers.parse_bytes(F.col("t")).alias("b"), numbers.number_or_null(F.col("t")).alias("n"), numbers.parse_length(F.col("t")).alias("l")).collect()
    assert [r.b for r in got] == [13107200, 3072, None, None, None]
    assert [r.n for r in got] == [None] * 5
    assert [r.l for r in got] == [12.5, 3.0, None, None, None]


def test_pairs_within_matches_brute_force(spark):
    rng = random.Random(3)
    left = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(60)]
    right = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(70)]
    schema = "id int, x double, z double"
    got = spatial.pairs_within(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 9.0).select("l.id", F.col("r.id").alias("other")).collect()
    want = {(a[0], b[0]) for a in left for b in right if math.hypot(a[1] - b[1], a[2] - b[2]) <= 9}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_pairs_within_empty(spark):
    none = spark.createDataFrame([], "id int, x double, z double")
    assert spatial.pairs_within(none, none, 5.0).count() == 0


def test_boxes_meeting_once(spark):
    rng = random.Random(4)
    make = lambda n: [(i, x, z, x + rng.uniform(0, 40), z + rng.uniform(0, 40)) for i in range(n) for x, z in [(rng.uniform(-90, 90), rng.uniform(-90, 90))]]
    a, b = make(25), make(25)
    schema = "id int, min_x double, min_z double, max_x double, max_z double"
    got = [tuple(r) for r in spatial.boxes_meeting(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 2.0, 16.0).select("l.id", F.col("r.id").alias("o")).collect()]
    want = {(p[0], q[0]) for p in a for q in b if p[1] - 2 <= q[3] and q[1] <= p[3] + 2 and p[2] - 2 <= q[4] and q[2] <= p[4] + 2}
    assert set(got) == want and len(got) == len(want)


def test_point_in_ring(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(z)).alias("z")) for x, z in ((0, 0), (4, 0), (4, 4), (0, 4))))
    got = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (None, 1.0)], "x double, z double").select(geometry.in_ring(F.col("x"), F.col("z"), ring).alias("i")).collect()
    assert [r.i for r in got][:2] == [True, False]


def test_fill_gaps_never_extrapolates(spark):
    rows = [(1, 0.0, None), (1, 1.0, 10.0), (1, 2.0, None), (1, 3.0, 30.0), (1, 50.0, None), (1, 99.0, 5.0), (1, 100.0, None)]
    got = {r.m: (r.filled, r.evidence) for r in windows.fill_gaps(spark.createDataFrame(rows, "k int, m double, v double"), ["k"], "m", "v", 12.0).collect()}
    assert got[0.0] == (None, "unresolved") and got[2.0] == (20.0, "interpolated") and got[50.0] == (None, "unresolved") and got[100.0] == (None, "unresolved")


def test_runs_with_nulls(spark):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")]
    got = windows.runs_of_equal(spark.createDataFrame(rows, "k int, n int, s string"), ["k"], ["n"], "s").orderBy("n").collect()
    assert [r.run for r in got] == [1, 1, 2, 2, 3]


def test_replaced(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    changes = spark.createDataFrame([(3, "c", 1), (4, "d", 9), (5, "e", None)], "id int, name string, replaces int")
    now, missing = spatial.replaced(base, changes, "id", "replaces")
    assert sorted(r.id for r in now.collect()) == [2, 3, 4, 5] and [r.id for r in missing.collect()] == [4]


def test_components_match_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {n: find(n) for n in got} and set(got) == {n for e in links if e[0] != e[1] for n in e}


def test_median_filter_single_cell(spark):
    got = raster.median_filter(spark.createDataFrame([(0, 0, 5.0)], "x long, z long, h double"), "h", 1.0).collect()
    assert [r.smoothed for r in got] == [5.0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), max_size=25), st.floats(1, 20))
def test_spacing(points, spacing):
    x, z = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    kept = graphs._spaced(x, z, spacing, 1 << 30)
    want: list[int] = []
    for i in range(len(points)):
        if all((x[i] - x[j]) ** 2 + (z[i] - z[j]) ** 2 >= spacing * spacing for j in want):
            want.append(i)
    assert kept == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 5)), min_size=1, max_size=3), min_size=1, max_size=5))
def test_best_path_is_best(options):
    options = [[(float(v), float(q)) for v, q in o] for o in options]
    measure = [10.0 * i for i in range(len(options))]

    def worth(path):
        total = options[0][path[0]][1]
        for t in range(1, len(path)):
            v, q = options[t][path[t]]
            jump = abs(v - options[t - 1][path[t - 1]][0])
            if jump / 10 > 3.5:
                return -math.inf
            total += q - 0.34 * jump - 1.8 * max(0.0, jump / 10 - 1.15)
        return total

    got = graphs.best_path(measure, options)
    assert math.isclose(worth(got), max(worth(p) for p in itertools.product(*(range(len(o)) for o in options))), abs_tol=1e-9)


def test_best_path_stops_where_no_step_leads_on():
    assert graphs.best_path([0.0, 10.0, 20.0], [[(0.0, 5.0)], [(100.0, 1.0)], [(101.0, 1.0), (0.0, 9.0)]]) == [-1, -1, 0]
    assert graphs.best_path([0.0, 10.0, 20.0], [[(0.0, 5.0)], [], [(101.0, 1.0), (0.0, 9.0)]]) == [0, -1, 1]
    assert graphs.best_path([0.0, 0.0], [[(0.0, 1.0)], [(0.8, 1.0), (1.0, 9.0)]]) == [0, 0]  # runs count as a quarter metre at least
    assert graphs.continuity([[(0.0, 1.0)], [(2.0, 1.0), (9.0, 2.5)]], [0, 0]) == [(0.6, 0.0), (0.6, 0.5)]


def test_streamed_groups_match_per_group_results(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40) if rng.random() < 0.9 else None, i, float(rng.randrange(60)), float(rng.randrange(60))) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, n int, x double, z double")
    want = set()
    for k in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        want |= {group[i] for i in graphs._spaced(np.array([r[2] for r in group]), np.array([r[3] for r in group]), 9.0, 20)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        assert {tuple(r) for r in graphs.greedy_spacing(df, "k", ["n"], 9.0, 20).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert graphs.simplified(df.limit(0), "k", "n", 1.0).count() == 0


def test_simplify_keeps_corners():
    assert graphs.simplify([(0, 0), (5, 0.1), (10, 0), (10, 10)], 0.5) == [0, 2, 3]
    assert graphs.simplify([], 1) == []


def test_thin_and_chamfer():
    bar = np.zeros((7, 20), bool)
    bar[2:5, 2:18] = True
    line = graphs.thin(bar)
    assert line.sum(axis=0).max() == 1 and line.sum() >= 10
    assert graphs.chamfer(np.pad(np.ones((3, 3), bool), 1))[2, 2] == 20


def test_line_cells_symmetric():
    rng = random.Random(6)
    for _ in range(50):
        a, b, c, d = (rng.randrange(-9, 10) for _ in range(4))
        there = graphs.line_cells(a, b, c, d)
        assert there == graphs.line_cells(c, d, a, b)[::-1] and len(there) == max(abs(a - c), abs(b - d)) + 1


def test_watershed_splits_at_the_saddle():
    cells = {(x, 0): h for x, h in enumerate([9, 7, 3, 6, 8])}
    own = graphs.watershed(cells, [(0, 0), (4, 0)])
    assert own[(1, 0)] == 0 and own[(3, 0)] == 1


def test_clean_html(spark):
    page = "<p>a &amp; b</p><script>x<y</script><!-- c --> <b>d</b>"
    got = spark.createDataFrame([(page,), ("",), (None,)], "h string").select(text.clean_html(F.col("h")).alias("t")).collect()
    assert [r.t for r in got] == ["a & b d", "", None]
