"""List ranking and components against plain versions on random links."""

from __future__ import annotations

import random

import pytest

from fieldloom.operators import chains, graphs


def plain_ranks(before: dict[int, int | None]) -> dict[int, tuple]:
    out = {}
    for node in before:
        way, at = [node], before[node]
        while at is not None and at in before and at not in way:
            way.append(at)
            at = before[at]
        if at is not None and at in before:  # a ring, as no node has two that follow it
            head = min(way)
            out[node] = (head, way.index(head), True)
        else:
            out[node] = (way[-1], len(way) - 1, False)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ranks_of_chains_and_rings(spark, seed):
    rng = random.Random(seed)
    nodes, before = list(range(120)), {}
    rng.shuffle(nodes)
    while nodes:
        part = [nodes.pop() for _ in range(min(len(nodes), rng.choice([1, 2, 3, 9, 40])))]
        ring = rng.random() < 0.4
        for i, n in enumerate(part):
            before[n] = part[i - 1] if i else part[-1] if ring else rng.choice([None, 1000 + n])
    df = spark.createDataFrame(list(before.items()), "node long, before long")
    got = {r.node: (r.head, r.place, r.closed) for r in chains.ranked(df).collect()}
    assert got == plain_ranks(before)


def test_no_links(spark):
    none = spark.createDataFrame([], "node long, before long")
    assert chains.ranked(none).count() == 0
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == root
