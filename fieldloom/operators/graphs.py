"""Graph and sequential operators.

Components work on links of any number. Operators that are sequential by nature (greedy
spacing, dynamic programming, watershed, thinning, simplification) run per group in Arrow-backed
Python; their groups are single features or tiles, bounded by the feature, never a whole table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from fieldloom.operators.tables import Scratch


def streamed(rows: DataFrame, key: str, order: list[str], added: str, solve: Callable[[dict[str, list]], dict[str, list]], read: list[str] | None = None) -> DataFrame:
    """Rows with the columns `added` (DDL), which solve makes from the columns (or only those in `read`) of one group in order; rows whose first added value is null go.

    Partitions are sorted and streamed, so many small groups cost no call to a frame each, and a task holds one batch and one group.
    """
    from pyspark.sql import types as T

    names, more = rows.columns, T._parse_datatype_string(added).fields
    schema = T.StructType([*rows.schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def solved(table: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            columns = {c: table.column(c).to_pylist() for c in read or names}
            keys = columns[key] if key in columns else table.column(key).to_pylist()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            whole = cuts if last else cuts[:-1]
            new: dict[str, list] = {f.name: [] for f in more}
            for a, b in zip(whole, whole[1:]):
                got = solve({c: v[a:b] for c, v in columns.items()})
                for c in new:
                    new[c] += got[c]
            end = whole[-1] if whole else 0
            done = table.slice(0, end)
            for f in more:
                done = done.append_column(f.name, pa.array(new[f.name], to_arrow_type(f.dataType)))
            return done.filter(done.column(more[0].name).is_valid()).to_batches(), table.slice(end)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            out, rest = solved(table if rest is None else pa.concat_tables([rest, table]).combine_chunks(), False)
            yield from out
        if rest is not None and len(rest):
            yield from solved(rest, True)[0]

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for links (a, b): the least node of each component, by alternating large-star and small-star steps.

    A large star ties every larger neighbour of a node to the least node around, a small star the smaller ones; rounds grow with the
    logarithm of the nodes. A node's least neighbour comes from a combining aggregation and a join that Spark can
    split, so a node may have any number of links. Nodes that are only linked to themselves are no rows.
    """
    tables = Scratch(links.sparkSession)
    pairs = tables.saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        large = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").filter("v > u")
        large = large.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = tables.saved(small)
        tables.discard(pairs)
        pairs = new
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v").distinct())
        seen = now


def network_summary(links: DataFrame) -> DataFrame:
    """(measure, n): components, nodes, edges and dangling nodes of a network."""
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    nodes = degree.agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") == 1).alias("dangling"), F.coalesce((F.sum("degree") / 2).cast("bigint"), F.lit(0)).alias("edges"))
    parts = components(links).agg(F.countDistinct("root").alias("n")).select(F.lit("components").alias("measure"), "n")
    return nodes.select(F.expr("stack(3, 'nodes', nodes, 'dangling', dangling, 'edges', edges) as (measure, n)")).union(parts)


def _spaced(x: np.ndarray, z: np.ndarray, spacing: float, most: int) -> list[int]:
    grid: dict[tuple[int, int], list[int]] = {}
    kept: list[int] = []
    for i in range(len(x)):
        if len(kept) >= most:
            break
        cx, cz = int(x[i] // spacing), int(z[i] // spacing)
        near = (j for a in (cx - 1, cx, cx + 1) for b in (cz - 1, cz, cz + 1) for j in grid.get((a, b), ()))
        if all((x[i] - x[j]) ** 2 + (z[i] - z[j]) ** 2 >= spacing * spacing for j in near):
            kept.append(i)
            grid.setdefault((cx, cz), []).append(i)
    return kept


#: Groups of at most so many rows are streamed one at a time; larger ones are spaced in rounds over cells.
SMALL_GROUP = 50_000


def greedy_spacing(rows: DataFrame, key: str, order: list[str], spacing: float, most: int = 1 << 30, rounds: int = 12, small: int = SMALL_GROUP) -> DataFrame:
    """Rows of each group taken in order, each at least `spacing` from all taken before, up to `most`; ties of the order in any order.

    Groups of at most `small` rows go through sorted streams: one shuffle, and a task holds one of them. Larger groups are spaced in
    rounds over cells, so no task gathers one; both take the same rows. The keys of the larger groups are at most the rows over `small`.
    """
    tables = Scratch(rows.sparkSession)
    large = tables.saved(rows.groupBy(F.struct(key).alias("_key")).agg(F.count("*").alias("_n")).filter(F.col("_n") > small).select("_key"))
    in_large = F.struct(key) == F.col("_key")  # a struct, as null keys make a group too

    def solve(group: dict[str, list]) -> dict[str, list]:
        chosen = set(_spaced(np.array(group["x"], float), np.array(group["z"], float), spacing, most))
        return {"_taken": [True if i in chosen else None for i in range(len(group["x"]))]}

    streams = lambda df: streamed(df, key, order, "_taken boolean", solve, ["x", "z"]).drop("_taken")
    if large.isEmpty():
        tables.discard(large)
        return streams(rows)
    return streams(rows.join(large, in_large, "left_anti")).union(_spaced_in_rounds(rows.join(large, in_large, "left_semi"), key, order, spacing, most, rounds))


def _spaced_in_rounds(rows: DataFrame, key: str, order: list[str], spacing: float, most: int, rounds: int) -> DataFrame:
    """The same by cells, which are so small that two rows of a group in one cell are always too near.

    In each round the first row of a cell is taken if it comes before the first rows of all cells in reach, and the rows too near a
    taken one go; that is what taking them one by one gives, but a cell sends one row and no group is gathered. What an order along a
    line leaves after `rounds` is taken one by one, in sorted streams.
    """
    tables = Scratch(rows.sparkSession)
    side = spacing / 1.4143
    base = tables.saved(rows.withColumn("_id", F.monotonically_increasing_id()))
    at = F.struct(*order, "_id", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"))
    cell = [F.floor(F.col(c) / side).alias(f"_{c}") for c in "xz"]
    left = tables.saved(base.select(F.struct(key).alias("_key"), *cell, at.alias("_at")))
    reach = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3)))).alias("_o")
    sent = lambda df: df.select("_key", "_x", "_z", "_at", reach).select("_key", (F.col("_x") + F.col("_o.a")).alias("_x"), (F.col("_z") + F.col("_o.b")).alias("_z"), "_at")
    where, taken = ["_key", "_x", "_z"], []
    while not left.isEmpty() and len(taken) < rounds:
        firsts = tables.saved(left.groupBy(*where).agg(F.min("_at").alias("_at")))
        least = sent(firsts).groupBy(*where).agg(F.min("_at").alias("_least"))
        taken.append(tables.saved(firsts.join(least, where).filter("_at = _least").drop("_least")))
        near = sent(taken[-1]).groupBy(*where).agg(F.collect_list(F.struct("_at.x", "_at.z")).alias("_near"))  # at most one of each cell in reach
        close = F.exists("_near", lambda p: F.pow(p.x - F.col("_at.x"), F.lit(2)) + F.pow(p.z - F.col("_at.z"), F.lit(2)) < spacing * spacing)
        new = tables.saved(left.join(near, where, "left").filter(F.col("_near").isNull() | ~close).drop("_near"))
        tables.discard(left, firsts)
        left = new
    ids = [x.select(F.col("_at._id").alias("_id")) for x in taken]
    if not left.isEmpty():

        def solve(group: dict[str, list]) -> dict[str, list]:
            chosen = set(_spaced(np.array([p["x"] for p in group["_at"]], float), np.array([p["z"] for p in group["_at"]], float), spacing, most))
            return {"_taken": [True if i in chosen else None for i in range(len(group["_at"]))]}

        ids.append(streamed(left.select("_key", "_at"), "_key", ["_at"], "_taken boolean", solve).select(F.col("_at._id").alias("_id")))
    if not ids:
        return base.drop("_id")
    chosen = base.join(reduce(DataFrame.union, ids), "_id")
    if most < 1 << 30:
        chosen = chosen.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order, "_id"))).filter(F.col("_nth") <= most).drop("_nth")  # tasks keep their first `most` before they send
    return chosen.drop("_id")


#: Fixed values of the continuity choice: cost of a metre's jump, slope without extra cost and its cost, slope ruled out, least run in metres.
BEND, EASY, STEEP, FORBIDDEN, LEAST_RUN = 0.34, 1.15, 1.8, 3.5, 0.25


def best_path(measure: list[float], options: list[list[tuple[float, float]]]) -> list[int]:
    """The option at each sample that maximises total quality less the costs of jumps and steep slopes; options: (value, quality) per sample.

    Runs of samples without options part the line (-1 there). A slope beyond FORBIDDEN is ruled out; an option that no step reaches
    is worth nothing, and what lies before it in its run stays unchosen (-1).
    """
    chosen, t = [-1] * len(options), 0
    while t < len(options):
        if not options[t]:
            t += 1
            continue
        start, score, back = t, [[q for _, q in options[t]]], [[-1] * len(options[t])]
        while t + 1 < len(options) and options[t + 1]:
            t += 1
            run = max(LEAST_RUN, measure[t] - measure[t - 1])
            row, link = [], []
            for value, quality in options[t]:
                best, via = -math.inf, -1
                for j, (before, _) in enumerate(options[t - 1]):
                    jump = abs(value - before)
                    if jump / run <= FORBIDDEN:
                        got = score[-1][j] + quality - BEND * jump - STEEP * max(0.0, jump / run - EASY)
                        if got > best:
                            best, via = got, j
                row.append(best)
                link.append(via)
            score.append(row)
            back.append(link)
        at = max(range(len(options[t])), key=lambda j: (score[-1][j], -j))
        for i in range(t, start - 1, -1):
            chosen[i] = at
            at = back[i - start][at]
            if at < 0:
                break
        t += 1
    return chosen


def continuity(options: list[list[tuple[float, float]]], chosen: list[int]) -> list[tuple[float, float]]:
    """How well each chosen option goes on from the one before (0.6 at a start), and how near in quality another option is."""
    held = lambda x: max(0.0, min(1.0, x))
    out = []
    for t, at in enumerate(chosen):
        if at < 0:
            out.append((0.0, 0.0))
            continue
        value, quality = options[t][at]
        other = next((q for j, (_, q) in enumerate(options[t]) if j != at), None)
        first = t == 0 or not options[t - 1]
        before = options[t - 1][chosen[t - 1]][0] if not first and chosen[t - 1] >= 0 else value
        out.append((0.6 if first else held(1 - abs(value - before) / 5), 0.0 if other is None else held(1 - abs(quality - other) / 3)))
    return out


def continuity_choice(rows: DataFrame, key: str, sample: str, measure: str, value: str, quality: str, base: str | None = None) -> DataFrame:
    """The candidate chosen at each sample of each line; adds `chosen`, and `confidence` of the chosen ones from the column `base` (0 without)."""
    def solve(group: dict[str, list]) -> dict[str, list]:
        n = len(group[sample])
        cuts = [0, *(i for i in range(1, n) if group[sample][i] != group[sample][i - 1]), n]
        parts = list(zip(cuts, cuts[1:]))
        options = [list(zip(group[value][a:b], group[quality][a:b])) for a, b in parts]
        path = best_path([float(group[measure][a]) for a, _ in parts], options)
        out, trust = [False] * n, [None] * n
        for (a, _), j, (smooth, unsure) in zip(parts, path, continuity(options, path)):
            if j >= 0:
                out[a + j] = True
                trust[a + j] = max(0.0, min(0.9, (group[base][a + j] if base else 0.0) + 0.12 * smooth - 0.08 * unsure))
        return {"chosen": out, "confidence": trust}

    return streamed(rows, key, [sample, value], "chosen boolean, confidence double", solve)


def watershed(cells: dict[tuple[int, int], float], seeds: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """The seed that reaches each cell over the highest lowest cell; ties by straight distance to the seed, then its number."""
    owner: dict[tuple[int, int], int] = {}
    queue = [(-cells[s], 0.0, i, s) for i, s in enumerate(seeds) if s in cells]
    heapq.heapify(queue)
    while queue:
        low, _, i, at = heapq.heappop(queue)
        if at in owner:
            continue
        owner[at] = i
        for dx in (-1, 0, 1):
            for dz in (-1, 0, 1):
                to = (at[0] + dx, at[1] + dz)
                if to in cells and to not in owner:
                    heapq.heappush(queue, (max(low, -cells[to]), math.hypot(to[0] - seeds[i][0], to[1] - seeds[i][1]), i, to))
    return owner


def crowns(cells: DataFrame, key: str, value: str, seed: str) -> DataFrame:
    """The seed number (order of z, x) that each cell of a group belongs to; cells out of reach are left out.

    A group is one feature's cells or one tile in x and z: its size is bounded by the tile, not by the raster.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        at = {(int(x), int(z)): float(v) for x, z, v in zip(group["x"], group["z"], group[value])}
        seeds = sorted(((int(x), int(z)) for x, z, s in zip(group["x"], group["z"], group[seed]) if s), key=lambda p: (p[1], p[0]))
        own = watershed(at, seeds)
        k = group[key].iloc[0]
        return pd.DataFrame([(k, x, z, i) for (x, z), i in own.items()], columns=[key, "x", "z", "crown"])

    kind = cells.schema[key].dataType.simpleString()
    return cells.groupBy(key).applyInPandas(run, f"{key} {kind}, x long, z long, crown int")


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[int]:
    """Douglas-Peucker: indexes of the vertices that stay."""
    if len(points) < 3:
        return list(range(len(points)))
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        (ax, az), (bx, bz) = points[a], points[b]
        dx, dz = bx - ax, bz - az
        size = dx * dx + dz * dz
        worst, far = -1, tolerance
        for i in range(a + 1, b):
            px, pz = points[i]
            s = 0.0 if size == 0 else max(0.0, min(1.0, ((px - ax) * dx + (pz - az) * dz) / size))
            gap = math.hypot(px - ax - s * dx, pz - az - s * dz)
            if gap > far:
                worst, far = i, gap
        if worst >= 0:
            keep.add(worst)
            stack += [(a, worst), (worst, b)]
    return sorted(keep)


def simplified(lines: DataFrame, key: str, order: str, tolerance: float) -> DataFrame:
    """The vertices of each line that stay."""
    def solve(group: dict[str, list]) -> dict[str, list]:
        kept = set(simplify(list(zip(group["x"], group["z"])), tolerance))
        return {"_kept": [True if i in kept else None for i in range(len(group["x"]))]}

    return streamed(lines, key, [order], "_kept boolean", solve).drop("_kept")


def thin(mask: np.ndarray, rounds: int = 256) -> np.ndarray:
    """Zhang-Suen thinning of a boolean image."""
    image = np.pad(mask.astype(np.uint8), 1)
    for _ in range(rounds):
        changed = False
        for half in (0, 1):
            n = [np.roll(image, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            turns = sum((n[i] == 0) & (n[(i + 1) % 8] == 1) for i in range(8))
            count = sum(x.astype(int) for x in n)
            a, b = (n[0] * n[2] * n[4], n[2] * n[4] * n[6]) if half == 0 else (n[0] * n[2] * n[6], n[0] * n[4] * n[6])
            gone = (image == 1) & (turns == 1) & (count >= 2) & (count <= 6) & (a == 0) & (b == 0)
            if gone.any():
                image[gone], changed = 0, True
        if not changed:
            break
    return image[1:-1, 1:-1].astype(bool)


def line_cells(x0: int, z0: int, x1: int, z1: int) -> list[tuple[int, int]]:
    """Bresenham's cells of a segment, both ends included, the same from either end."""
    if (x1, z1) < (x0, z0):
        return line_cells(x1, z1, x0, z0)[::-1]
    dx, dz = abs(x1 - x0), -abs(z1 - z0)
    sx, sz = (1 if x0 < x1 else -1), (1 if z0 < z1 else -1)
    error, out = dx + dz, []
    while True:
        out.append((x0, z0))
        if (x0, z0) == (x1, z1):
            return out
        twice = 2 * error
        if twice >= dz:
            error, x0 = error + dz, x0 + sx
        if twice <= dx:
            error, z0 = error + dx, z0 + sz


def chamfer(mask: np.ndarray) -> np.ndarray:
    """Distance to the nearest false cell in tenths: 10 beside, 14 diagonally."""
    far = 1 << 28
    d = np.pad(np.where(mask, far, 0), 1, constant_values=far)
    rows, columns = d.shape
    for r in range(1, rows - 1):
        for c in range(1, columns - 1):
            d[r, c] = min(d[r, c], d[r - 1, c] + 10, d[r, c - 1] + 10, d[r - 1, c - 1] + 14, d[r - 1, c + 1] + 14)
    for r in range(rows - 2, 0, -1):
        for c in range(columns - 2, 0, -1):
            d[r, c] = min(d[r, c], d[r + 1, c] + 10, d[r, c + 1] + 10, d[r + 1, c + 1] + 14, d[r + 1, c - 1] + 14)
    return d[1:-1, 1:-1]
