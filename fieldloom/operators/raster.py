"""Cell-table operators: rows (x, z, ...) of whole grid cells.

Neighbourhoods are built by sending each cell to the cells around it and aggregating there, one
shuffle on the cell, whatever the size of the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AROUND = [(dx, dz) for dx in (-1, 0, 1) for dz in (-1, 0, 1) if (dx, dz) != (0, 0)]
BESIDE = [(1, 0), (-1, 0), (0, 1), (0, -1)]


def offsets(pairs: list[tuple[int, int]]) -> Column:
    return F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dz")) for a, b in pairs))


def sent(cells: DataFrame, pairs: list[tuple[int, int]], *columns: str) -> DataFrame:
    """Each cell's columns at the cells that it neighbours."""
    out = cells.withColumn("_o", F.explode(offsets(pairs)))
    return out.select((F.col("x") + F.col("_o.dx")).alias("x"), (F.col("z") + F.col("_o.dz")).alias("z"), *columns)


def cell_max(points: DataFrame, size: float, value: str, id: str) -> DataFrame:
    """The highest value of each cell; of equal ones the least id."""
    cell = lambda c: F.floor(F.col(c) / size + 0.5).cast("bigint").alias(c)
    best = points.select(cell("x"), cell("z"), value, id).groupBy("x", "z").agg(F.max(F.struct(F.col(value), (-F.col(id)).alias("_i"))).alias("m"))
    return best.select("x", "z", F.col(f"m.{value}").alias(value), (-F.col("m._i")).alias(id))


def local_maxima(cells: DataFrame, value: str, least: float) -> DataFrame:
    """Cells of at least `least` that no neighbour exceeds; of a plateau of two, the one with the lesser (z, x)."""
    own = cells.withColumn("_me", F.struct(F.col(value).alias("v"), (-F.col("z")).alias("nz"), (-F.col("x")).alias("nx")))
    around = sent(own, AROUND, "_me").groupBy("x", "z").agg(F.max("_me").alias("_best"))
    met = own.join(around, ["x", "z"], "left")
    return met.filter((F.col(value) >= least) & (F.col("_best").isNull() | (F.col("_me") > F.col("_best")))).drop("_me", "_best")


def boundary_cells(cells: DataFrame) -> DataFrame:
    """Cells with fewer than four neighbours beside them in the table."""
    one = cells.select("x", "z").distinct()
    beside = sent(one, BESIDE).groupBy("x", "z").agg(F.count("*").alias("_n"))
    return one.join(beside, ["x", "z"], "left").filter(F.coalesce("_n", F.lit(0)) < 4).select("x", "z")


def majority(cells: DataFrame, fill: int = 6, drop: int = 1) -> DataFrame:
    """Cells after one pass: empty ones with at least `fill` set neighbours join, set ones with at most `drop` leave."""
    one = cells.select("x", "z").distinct().withColumn("_set", F.lit(1))
    seen = sent(one, AROUND).groupBy("x", "z").agg(F.count("*").alias("_n"))
    both = one.join(seen, ["x", "z"], "full")
    stays = F.when(F.col("_set") == 1, F.coalesce("_n", F.lit(0)) > drop).otherwise(F.col("_n") >= fill)
    return both.filter(stays).select("x", "z")


def median_filter(cells: DataFrame, value: str, most: float, least: int = 3) -> DataFrame:
    """The median of a cell and its neighbours, held within `most` of the cell; the cell itself where fewer than `least` are known."""
    near = sent(cells, [(0, 0), *AROUND], value).groupBy("x", "z").agg(F.percentile(value, F.lit(0.5)).alias("_m"), F.count(value).alias("_n"))
    met = cells.join(near, ["x", "z"])
    held = F.greatest(F.least(F.col("_m"), F.col(value) + most), F.col(value) - most)
    return met.withColumn("smoothed", F.when(F.col("_n") >= least, held).otherwise(F.col(value))).drop("_m", "_n")


def painted(layers: DataFrame, rank: Column, order: str) -> DataFrame:
    """The layer that shows in each cell: the highest rank, then the last painted."""
    return layers.groupBy("x", "z").agg(F.max_by("layer", F.struct(rank, F.col(order))).alias("layer"))


def scanlines(polygons: DataFrame, id: str, ring: str) -> DataFrame:
    """Row spans (id, z, first, last) of cells whose centres lie in a polygon, by the even-odd rule at row centres."""
    edge = F.transform(F.sequence(F.lit(1), F.size(ring)), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, F.pmod(i, F.size(ring)) + 1).alias("b")))
    edges = polygons.select(id, F.explode(edge).alias("e")).filter("e.a.z <> e.b.z")
    low, high = F.least("e.a.z", "e.b.z"), F.greatest("e.a.z", "e.b.z")
    first, last = F.ceil(low - 0.5).cast("bigint"), (F.ceil(high - 0.5) - 1).cast("bigint")
    rows = edges.filter(first <= last).select(id, "e", F.explode(F.sequence(first, last)).alias("z"))
    at = F.col("e.a.x") + (F.col("z") + 0.5 - F.col("e.a.z")) * (F.col("e.b.x") - F.col("e.a.x")) / (F.col("e.b.z") - F.col("e.a.z"))
    cuts = rows.groupBy(id, "z").agg(F.sort_array(F.collect_list(at)).alias("c"))  # as many as a polygon has edges
    pairs = cuts.select(id, "z", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1, F.lit(2)), lambda i: F.struct(F.element_at("c", i).alias("p"), F.element_at("c", i + 1).alias("q")))).alias("s"))
    spans = pairs.select(id, "z", F.ceil(F.col("s.p") - 0.5).cast("bigint").alias("first"), F.floor(F.col("s.q") - 0.5).cast("bigint").alias("last"))
    return spans.filter("first <= last")


def split_chunks(boxes: DataFrame, size: int = 16) -> DataFrame:
    """Boxes (x1, z1, x2, z2) cut along chunk borders, with chunk_x and chunk_z."""
    part = lambda c: F.floor(F.col(c) / size).cast("bigint")
    out = boxes.withColumn("chunk_x", F.explode(F.sequence(part("x1"), part("x2")))).withColumn("chunk_z", F.explode(F.sequence(part("z1"), part("z2"))))
    held = {f"{a}1": F.greatest(F.col(f"{a}1"), F.col(f"chunk_{a}") * size) for a in "xz"} | {f"{a}2": F.least(F.col(f"{a}2"), F.col(f"chunk_{a}") * size + size - 1) for a in "xz"}
    return out.withColumns(held)


def bilinear(asked: DataFrame, cells: DataFrame, id: str, value: str) -> DataFrame:
    """Values between cell centres (at .5): weights of missing cells go to the known ones; null without any."""
    x, z = F.col("ax") - 0.5, F.col("az") - 0.5
    corners = asked.select(id, x.alias("u"), z.alias("v"), F.explode(offsets([(0, 0), (1, 0), (0, 1), (1, 1)])).alias("o"))
    fx, fz = F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
    weight = F.when(F.col("o.dx") == 1, fx).otherwise(1 - fx) * F.when(F.col("o.dz") == 1, fz).otherwise(1 - fz)
    corners = corners.select(id, (F.floor("u") + F.col("o.dx")).alias("x"), (F.floor("v") + F.col("o.dz")).alias("z"), weight.alias("w")).filter("w > 0")
    got = corners.join(cells.select("x", "z", value).filter(F.col(value).isNotNull()), ["x", "z"]).groupBy(id).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))
    return asked.select(id).join(got, id, "left")
