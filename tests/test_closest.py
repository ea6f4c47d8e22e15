"""Nearest partners against brute force, and that their candidates don't grow with the pairs in reach."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import closest, paths, relations, spatial

KIND = "id long, kind int, min_x double, max_x double, min_z double, max_z double"


def boxes(rng, n, first, wide, spread):
    out = []
    for i in range(n):
        x, z = rng.choice([(round(rng.gauss(0, spread)), round(rng.gauss(0, spread))), (rng.uniform(-200, 200), rng.uniform(-200, 200)), (7.0, 7.0)])
        out.append((first + i, rng.choice([1, 2, None]), float(x), x + rng.choice(wide), float(z), z + rng.choice(wide)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("reach", "most", "wide", "same"), [(40.0, 3, (0.0,), None), (15.0, 2, (0.0, 3.0, 40.0), {"kind": "kind"}), (0.0, 2, (2.0, 6.0), None)])
def test_nearest_within_matches_brute_force(spark, monkeypatch, reach, most, wide, same):
    monkeypatch.setattr(closest, "FEW", 3)
    rng = random.Random(int(reach))
    left, right = boxes(rng, 300, 0, wide, 9), boxes(rng, 300, 1000, wide, 9)
    left.append((999, 1, None, None, 0.0, 0.0))
    gap = lambda a, b, i: max(0.0, a[i] - b[i + 1], b[i] - a[i + 1])
    want = set()
    for a in left[:-1]:
        met = sorted((math.hypot(gap(a, b, 2), gap(a, b, 4)), b[0]) for b in right if not same or a[1] is not None and a[1] == b[1])
        want |= {(a[0], b, n + 1) for n, (d, b) in enumerate([m for m in met if m[0] <= reach][:most])}
    got = closest.nearest_within(spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND), reach, most, same)
    assert {tuple(r) for r in got.select("l.id", F.col("r.id").alias("o"), "place").collect()} == want


def test_crowded_rows_meet_few_candidates(spark, monkeypatch):
    """A join of all pairs in reach would make 640 000 of them."""
    sizes, keep = [], closest.Scratch.saved
    monkeypatch.setattr(closest.Scratch, "saved", lambda self, df: (lambda out: sizes.append(out.count()) or out)(keep(self, df)))
    point = lambda n: closest.as_boxes(spark.range(n).select("id", (F.col("id") * 37 % 53).alias("x"), (F.col("id") * 11 % 59).alias("z")))
    assert closest.nearest_within(point(800), point(800), 100.0, 1).count() == 800
    assert max(sizes) < 100_000


def no_pairs(*args, **more):
    raise AssertionError("a join of all pairs in reach")


def crowd(spark, n, first, extra):
    return spark.range(first, first + n).selectExpr("id", "cast(id * 37 % 23 as double) as x", "cast(id * 11 % 29 + 40 * (id % 3) as double) as z", extra)


def apart(a, b):
    return math.hypot(a.x - b.x, a.z - b.z)


def test_entrances_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(paths, "pairs_within", no_pairs)
    doors, buildings = crowd(spark, 150, 0, "id % 5 as rank"), crowd(spark, 90, 500, "0 as rank")
    best, there = {}, buildings.collect()
    for a in doors.collect():
        d, b = min((apart(a, b), b.id) for b in there)
        if d <= 20:
            best[b] = min(best.get(b, (9, 0)), (-a.rank, a.id))
    assert {(r.building, r.door) for r in paths.entrances(doors, buildings, 20.0).collect()} == {(b, k[1]) for b, k in best.items()}


def test_relations_without_all_pairs(spark, monkeypatch):
    """Crowded nodes of two types; brute force, and no table on the way as large as the pairs in reach."""
    sizes, keep = [], closest.Scratch.saved
    monkeypatch.setattr(closest.Scratch, "saved", lambda self, df: (lambda out: sizes.append(out.count()) or out)(keep(self, df)))
    kind = "case when id % 2 = 0 then 'building' else 'path' end as type"
    nodes = closest.as_boxes(crowd(spark, 1200, 0, kind)).withColumns({"max_x": F.col("max_x") + 6, "max_z": F.col("max_z") + 4, "base": F.lit(0.0), "confidence": F.lit(None).cast("double")})
    want, pairs, rows = set(), 0, nodes.collect()
    gap = lambda a, b, c: max(0.0, a[f"min_{c}"] - b[f"max_{c}"], b[f"min_{c}"] - a[f"max_{c}"])
    for a in (r for r in rows if r.type == "building"):
        met = sorted((math.hypot(gap(a, b, "x"), gap(a, b, "z")), b.id) for b in rows if b.type == "path")
        near = [m for m in met if m[0] <= 12]
        pairs += len(near)
        want |= {(b, a.id, d) for d, b in near[:3]}
    assert {(r.from_id, r.to_id, r.distance_m) for r in relations.inferred(nodes).collect()} == want
    assert sizes and max(sizes) < pairs


def test_labels_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(paths, "pairs_within", no_pairs)
    labels, shapes = crowd(spark, 150, 0, "id % 5 * 10 as priority"), crowd(spark, 90, 500, "0 as priority")
    best, there = {}, shapes.collect()
    for a in labels.collect():
        met = [(apart(a, b), b.id) for b in there if apart(a, b) <= 6]
        for d, b in met if len(met) <= 3 else []:
            best[b] = min(best.get(b, (99, 0)), (d - 0.08 * a.priority, a.id))
    assert {(r.shape, r.label) for r in paths.labelled(labels, shapes, 6.0, 3).collect()} == {(b, k[1]) for b, k in best.items()}


def test_linear_reference_aggregates_without_sorting_pairs(spark):
    points = spark.createDataFrame([(1, 0, 5.0, 1.0), (2, 0, 10.0, 0.0)], "id long, k int, x double, z double")
    segments = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 0.0, 0.0), (0, 10.0, 0.0, 10.0, 9.0, 100.0)], "k int, ax double, az double, bx double, bz double, start double")
    found = spatial.linear_reference(points, segments, ["k"], 4.0)
    assert {tuple(r) for r in found.collect()} == {(1, 1.0, 5.0), (2, 0.0, 10.0)}  # a tie takes the lower measure
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
