"""Crowns from connected canopy, and spacing in rounds, against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from fieldloom.operators import canopy, graphs


def plain_crowns(trees, samples, size, farthest):
    best = {}
    near = lambda v: math.floor(v / size + 0.5)
    for x, z, h, base in samples:
        if h is not None and h >= 2:
            g = (near(x), near(z))
            if g not in best or (h, -z, -x) > (best[g][2], -best[g][1], -best[g][0]):
                best[g] = (x, z, h, base)
    out = {}
    for k, x, z in trees:
        gap, cell = min(((math.hypot(s[0] - x, s[1] - z), s[1], s[0]), g) for g, s in best.items())
        if gap[0] > max(1.75 * size, farthest):
            continue
        seen, queue = {cell}, [cell]
        while queue:
            a, b = queue.pop()
            for n in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if n in best and n not in seen:
                    seen.add(n)
                    queue.append(n)
        crown = [best[g] for g in seen]
        half, bases = size / 2, [s[3] for s in crown if s[3] is not None]
        out[k] = (
            max(half, x - min(s[0] for s in crown) + half), max(half, max(s[0] for s in crown) + half - x), max(half, z - min(s[1] for s in crown) + half), max(half, max(s[1] for s in crown) + half - z),
            max(s[2] for s in crown), float(np.percentile(bases, 25)) if bases else None, len(crown),
        )
    return out


@pytest.mark.parametrize(("seed", "size"), [(1, 1.0), (2, 0.5), (3, 2.0)])
def test_crowns(spark, seed, size):
    rng = random.Random(seed)
    samples = [(rng.uniform(-30, 30), rng.uniform(-30, 30), rng.choice([None, 1.0, 2.0, 5.5, 9.0]), rng.choice([None, 0.5, 1.5])) for _ in range(900)]
    trees = [(i, rng.uniform(-40, 40), rng.uniform(-40, 40)) for i in range(60)]
    df = spark.createDataFrame(samples, "x double, z double, canopy double, base double").repartition(5)
    got = {r.tree_id: r for r in canopy.crowns(spark.createDataFrame(trees, "tree_id int, x double, z double"), df, size=size).collect()}
    want = plain_crowns(trees, samples, size, 3.0)
    assert set(got) == set(want)
    for k, w in want.items():
        r = got[k]
        assert [r.west, r.east, r.north, r.south, r.max_canopy] == pytest.approx(w[:5], abs=6e-4) and (r.crown_base == pytest.approx(w[5], abs=6e-4) if w[5] is not None else r.crown_base is None) and r.cells == w[6]


def test_no_canopy(spark):
    none = spark.createDataFrame([], "x double, z double, canopy double, base double")
    assert canopy.crowns(spark.createDataFrame([(1, 0.0, 0.0)], "tree_id int, x double, z double"), none).count() == 0


@pytest.mark.parametrize(("rounds", "most"), [(12, 1 << 30), (1, 1 << 30), (3, 7)])
def test_spacing_is_the_sequential_one(spark, rounds, most):
    rng = random.Random(rounds)
    rows = [("hot", i, rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(1200)] + [("line", i, i * 0.4, 0.0) for i in range(300)] + [("same", i, 1.0, 1.0) for i in range(50)] + [("one", 0, 5.0, 5.0)]
    want = set()
    for k in ("hot", "line", "same", "one"):
        mine = [r for r in rows if r[0] == k]
        want |= {mine[i] for i in graphs._spaced(np.array([r[2] for r in mine]), np.array([r[3] for r in mine]), 3.0, most)}
    df = spark.createDataFrame(rows, "k string, n int, x double, z double").repartition(6)
    assert {tuple(r) for r in graphs.greedy_spacing(df, "k", ["n"], 3.0, most, rounds).collect()} == want


@pytest.mark.parametrize(("rounds", "most"), [(12, 1 << 30), (1, 1 << 30), (3, 7)])
def test_spacing_of_large_groups_in_rounds_and_small_ones_in_streams(spark, rounds, most):
    rng = random.Random(rounds)
    rows = [(k, i, rng.uniform(0, 60), rng.uniform(0, 60)) for k in ("hot", None) for i in range(700)] + [("line", i, i * 0.4, 0.0) for i in range(300)] + [(f"k{i % 40}", i, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(800)]
    want = set()
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        want |= {mine[i] for i in graphs._spaced(np.array([r[2] for r in mine]), np.array([r[3] for r in mine]), 3.0, most)}
    df = spark.createDataFrame(rows, "k string, n int, x double, z double").repartition(6)
    assert {tuple(r) for r in graphs.greedy_spacing(df, "k", ["n"], 3.0, most, rounds, small=100).collect()} == want


def test_spacing_of_small_groups_takes_one_shuffle(spark):
    df = spark.createDataFrame([(i % 9, i, float(i % 13), float(i % 7)) for i in range(300)], "k int, n int, x double, z double")
    plan = graphs.greedy_spacing(df, "k", ["n"], 3.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
