"""Rings, regions, voxels, breakers and queues on small inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import discovery, paths, regions


def test_stitch():
    ways = [[(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 0)], [(5, 5), (6, 6)], [], [(9, 9)]]
    assert regions.stitch(ways) == [[(0, 0), (1, 0), (1, 1), (0, 0)]]


def test_rings(spark):
    rows = [(7, w, i, float(x), float(z)) for w, way in enumerate([[(0, 0), (2, 0)], [(2, 2), (2, 0)], [(2, 2), (0, 0)]]) for i, (x, z) in enumerate(way)]
    got = regions.rings(spark.createDataFrame(rows, "rel int, way int, seq int, x double, z double"), "rel").orderBy("seq").collect()
    assert [(r.x, r.z) for r in got] == [(0, 0), (2, 0), (2, 2), (0, 0)]


def test_regions(spark):
    cells = [(0, 0), (1, 0), (1, 1), (5, 5), (6, 6), (-3, -3), (-3, -4)]
    got = sorted(r.n for r in regions.large_regions(spark.createDataFrame(cells, "x long, z long"), 1).collect())
    assert got == [1, 1, 2, 3]
    assert regions.labelled(spark.createDataFrame([], "x long, z long")).count() == 0


def test_voxel_line(spark):
    c = [F.lit(float(v)) for v in (0, 0, 0, 4, 2, 0)]
    got = spark.range(1).select(regions.voxel_line(*c).alias("v")).first().v
    assert [tuple(p) for p in got] == [(0, 0, 0), (1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 2, 0)]
    one = spark.range(1).select(regions.voxel_line(*[F.lit(1.0)] * 6).alias("v")).first().v
    assert [tuple(p) for p in one] == [(1, 1, 1)]


def test_precedence(spark):
    rows = [(0, 0, 0, "leaf", 1, 9), (0, 0, 0, "trunk", 3, 1), (0, 0, 0, "bark", 3, 2), (1, 0, 0, "leaf", 1, 3)]
    got = regions.precedence(spark.createDataFrame(rows, "x int, y int, z int, block string, r int, n int"), F.col("r"), "n").orderBy("x").collect()
    assert [r.block for r in got] == ["bark", "leaf"]


def test_breaker(spark):
    rows = [("a", i, f) for i, f in enumerate([True, True, True, False, True, True, True])] + [("b", 0, None)]
    got = discovery.breaker_states(spark.createDataFrame(rows, "host string, n int, bad boolean"), "host", ["n"], "bad").filter("host = 'a'").orderBy("n").collect()
    assert [r.is_open for r in got] == [False, False, True, True, False, False, True]


def test_queue_limits(spark):
    rows = [(a, 10 - a, d, float(d)) for a in range(4) for d in range(5)]
    got = discovery.queue(spark.createDataFrame(rows, "application int, application_score int, document int, score double"), 2, [F.desc("score")], 5).orderBy("position").collect()
    assert [(r.application, r.document) for r in got] == [(0, 4), (0, 3), (1, 4), (1, 3), (2, 4)]


def test_complete_attempt(spark):
    rows = [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 0), (4, 0), (4, 2)]
    got = discovery.complete_attempt(spark.createDataFrame(rows, "attempt int, shard int"), 2).collect()
    assert sorted((r.attempt, r.shard) for r in got) == [(2, 0), (2, 1)]


def test_thinned(spark):
    rows = [("a", m) for m in (0.0, 0.1, 0.3, 0.5, 0.55, 2.0)]
    got = paths.thinned(spark.createDataFrame(rows, "k string, m double"), "k", "m", [F.lit(1)], 0.25).orderBy("m").collect()
    assert [r.m for r in got] == [0.0, 0.3, 0.55, 2.0]


def test_applications_by_site_category_and_exclusion(spark):
    fields = "reference string, address string, proposal string, description string, status string, discovery_score int"
    rows = [
        ("a1", "Lagoon World, Road", "New ride", "x", None, 5),  # site named: 5 + 100 + 240
        ("a2", "Blue  Lake Road", "A <b>ride</b> by the park", None, "withdrawn", None),  # word, its token, phrase, two tokens, address, ride, state
        ("a3", "Blue Lake Road", "A hotel", None, None, None),  # an address alone needs a ride
        ("a4", "Lagoon World", "", "Telecom mast for a mobile network", None, None),  # the description stands in
        ("a5", "Lagoon World", "Change of use", None, None, None),
        ("a6", None, None, None, None, None),
        ("a7", "Lagoon World", "Masterplan with telecom ducts", None, None, None),  # no reason to exclude
    ]
    names = lambda *xs: F.array(*map(F.lit, xs))
    got = {r.reference: r for r in discovery.application_class(spark.createDataFrame(rows, fields), names("Park", "Blue Lake"), F.lit("Lagoon World"), names()).collect()}
    assert [(got[k].score, got[k].relevant, got[k].site_match, got[k].excluded_reason) for k in sorted(got)] == [
        (345, True, "primary", None), (20 + 4 + 40 + 8 + 25 + 240 - 8, True, "secondary", None), (40 + 8 + 25 + 140, False, "secondary", "outside-park-identity"),
        (100 - 180, False, "primary", "telecommunications"), (100, False, "primary", "no-geometry-category"), (-200, False, "none", "outside-park-identity"), (220, True, "primary", None),
    ]
    assert got["a2"].categories == ["ride"]
