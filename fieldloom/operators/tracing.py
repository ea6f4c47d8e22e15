"""Lines and outlines from cells: skeleton graphs traced to edges, and regions traced to rings.

Both follow directed steps from cell to cell. Every step knows the one before it from its neighbours alone, and list
ranking (operators.chains) turns steps into edges and rings in a logarithm of rounds, whatever tile or partition the cells are in.
Cells lie within 2**27 of zero in x and z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.operators import chains
from fieldloom.operators.raster import AROUND, sent
from fieldloom.operators.regions import labelled

#: Least length in metres and least novel share of an edge, the share below which it mostly overlaps mapped routes, distance in metres that counts as at a mapped route.
LEAST_EDGE, LEAST_NOVEL, OVERLAPS, BUFFER = 5.0, 0.2, 0.35, 2.5
BITS, ZERO = 28, 1 << 27


def code(x: Column, z: Column) -> Column:
    """A cell as one number, ordered by z, then x."""
    return F.shiftleft((z + ZERO).cast("long"), BITS).bitwiseOR((x + ZERO).cast("long"))


def cell(of: Column) -> tuple[Column, Column]:
    """x and z of a code."""
    return of.bitwiseAND(F.lit((1 << BITS) - 1)) - ZERO, F.shiftright(of, BITS) - ZERO


def step(a: Column, b: Column) -> Column:
    """The step from one cell (code) to a neighbour as one number, ordered by the cell, then dz, then dx."""
    (ax, az), (bx, bz) = cell(a), cell(b)
    return a * 9 + (bz - az + 1) * 3 + (bx - ax + 1)


def traced(cells: DataFrame) -> DataFrame:
    """(edge, seq, x, z, run, closed): the skeleton's edges, each once, as their cells in order; run: cells to the next one, null at the end.

    Cells touch at sides and corners. An edge runs between cells with other than two neighbours over cells with two; a ring of
    cells with two neighbours each is an edge from its first cell (by z, x) back to it. Of the two directions the one with the lesser first step is
    kept. Cells that touch no other make no edge.
    """
    own = cells.select(F.col("x").cast("long").alias("x"), F.col("z").cast("long").alias("z")).distinct().withColumn("b", code(F.col("x"), F.col("z")))
    pairs = sent(own, AROUND, F.col("b").alias("a")).join(own, ["x", "z"]).select("a", "b")
    sides = pairs.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("low"), F.max("b").alias("high")).filter("n = 2").select(F.col("a").alias("mid"), "low", "high")
    met = pairs.join(sides, F.expr("a = mid"), "left")
    other = F.when(F.col("b") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    links = met.select(step(F.col("a"), F.col("b")).alias("node"), F.when(F.col("mid").isNotNull(), step(other, F.col("a"))).alias("before"), step(F.col("b"), F.col("a")).alias("back"), "a", "b")
    ranked = chains.ranked(links).join(links.drop("before"), "node")
    ends = ranked.groupBy("head").agg(F.max_by("back", "place").alias("reverse"), F.max("place").alias("last")).filter("head <= reverse")
    steps = ranked.join(ends, "head")
    (ax, az), (bx, bz) = cell(F.col("a")), cell(F.col("b"))
    run = F.when((ax == bx) | (az == bz), 1.0).otherwise(F.sqrt(F.lit(2.0)))
    here = F.struct(F.col("place").alias("seq"), F.col("a").alias("c"), run.alias("run"))
    end = F.struct((F.col("place") + 1).alias("seq"), F.col("b").alias("c"), F.lit(None).cast("double").alias("run"))
    points = steps.select(F.col("head").alias("edge"), "closed", F.explode(F.when(F.col("place") == F.col("last"), F.array(here, end)).otherwise(F.array(here))).alias("p"))
    x, z = cell(F.col("p.c"))
    return points.select("edge", "p.seq", x.alias("x"), z.alias("z"), "p.run", "closed")


def disc(radius: float) -> list[tuple[int, int]]:
    """Offsets of the cells whose centres are at most `radius` cells away."""
    r = int(radius)
    return [(dx, dz) for dx in range(-r, r + 1) for dz in range(-r, r + 1) if dx * dx + dz * dz <= radius * radius]


def classified(points: DataFrame, mapped: DataFrame, size: float = 1.0, buffer: float = BUFFER) -> DataFrame:
    """One row for each traced edge that is long and new enough: ends, length in metres, novel share, class and whether it overlaps.

    mapped: cells (x, z) of known routes; a point within `buffer` metres of one isn't novel, an end there is anchored.
    """
    near = sent(mapped.select("x", "z").distinct(), disc(buffer / size)).select("x", "z").distinct().withColumn("_near", F.lit(True))
    seen = points.join(near, ["x", "z"], "left").withColumn("_near", F.coalesce("_near", F.lit(False)))
    first, last = (lambda c: F.min_by(c, "seq")), (lambda c: F.max_by(c, "seq"))
    edges = seen.groupBy("edge").agg(
        first("x").alias("x1"), first("z").alias("z1"), last("x").alias("x2"), last("z").alias("z2"), F.count("*").alias("n_cells"),
        (F.count_if(F.col("run") == 1) + F.count_if(F.col("run") > 1) * F.sqrt(F.lit(2.0))).alias("_cells"), (F.count_if(~F.col("_near")) / F.count("*")).alias("novel"),
        first("_near").alias("start_anchored"), last("_near").alias("end_anchored"),
    )
    edges = edges.withColumn("length", F.col("_cells") * size).filter((F.col("length") >= LEAST_EDGE) & (F.col("novel") >= LEAST_NOVEL))
    kind = F.when(F.col("start_anchored") & F.col("end_anchored"), "connector").when(F.col("start_anchored") | F.col("end_anchored"), "extension").otherwise("image-visible-branch")
    return edges.withColumns({"classification": kind, "overlaps": F.col("novel") < OVERLAPS}).drop("_cells", "edge")


#: The sides of a cell clockwise from the top: where each begins and ends, and the neighbour across.
SIDES = (((0, 0), (1, 0), (0, -1)), ((1, 0), (1, 1), (1, 0)), ((1, 1), (0, 1), (0, 1)), ((0, 1), (0, 0), (-1, 0)))


def rings(cells: DataFrame, size: float = 1.0, left: float = 0.0, top: float = 0.0) -> DataFrame:
    """(region, ring, seq, x, z, area): the outlines of each region of cells that touch at sides, corners only, in metres; seq: sides of cells before the corner.

    Ring 0 of a region is its outline (positive area), the others are holes by falling size (negative area), then by their first corner. A ring begins at
    its first corner by z, then x. At a corner where cells touch diagonally a ring stays with its cell, so outlines of different regions
    never join.
    """
    region = labelled(cells)
    set_ = cells.select("x", "z").distinct()
    across = set_.select(F.col("x").alias("_x"), F.col("z").alias("_z"))
    side = F.array(*(F.struct(F.lit(i).alias("side"), *((F.col("x") + v[0]).alias(f"x{k}") for k, v in enumerate(s[:2], 1)), *((F.col("z") + v[1]).alias(f"z{k}") for k, v in enumerate(s[:2], 1)), (F.col("x") + s[2][0]).alias("nx"), (F.col("z") + s[2][1]).alias("nz")) for i, s in enumerate(SIDES)))
    edges = set_.select("x", "z", F.explode(side).alias("s")).select("x", "z", "s.*").join(across, F.expr("nx = _x and nz = _z"), "left_anti")
    edges = edges.withColumn("node", code(F.col("x1"), F.col("z1")) * 4 + F.col("side"))
    ends = edges.select(F.col("x2").alias("x1"), F.col("z2").alias("z1"), F.col("x").alias("px"), F.col("z").alias("pz"), F.col("side").alias("before_side"), F.col("node").alias("before"))
    # two edges end where cells touch diagonally: the one of the same cell goes before
    same = (F.col("px") == F.col("x")) & (F.col("pz") == F.col("z"))
    met = edges.join(ends, ["x1", "z1"]).groupBy("node", "x", "z", "x1", "z1", "x2", "z2", "side").agg(F.max_by(F.struct("before", "before_side"), same).alias("b"))
    met = met.select("node", "x", "z", "x1", "z1", "x2", "z2", "side", "b.*")
    ranked = chains.ranked(met).join(met, "node").withColumn("_turn", F.col("x1") * F.col("z2") - F.col("x2") * F.col("z1"))
    ranked = ranked.join(ranked.groupBy("head").agg((F.sum("_turn") / 2.0).alias("cells")), "head").join(region, ["x", "z"])
    by_size = Window.partitionBy("region").orderBy(F.col("cells") < 0, F.desc(F.abs("cells")), "head")  # a row for each ring
    order = ranked.filter("node = head").select("head", (F.row_number().over(by_size) - 1).alias("ring"))
    corners = ranked.filter(F.col("side") != F.col("before_side")).join(order, "head")
    return corners.select("region", "ring", F.col("place").alias("seq"), (left + F.col("x1") * size).alias("x"), (top + F.col("z1") * size).alias("z"), (F.col("cells") * (size * size)).alias("area"))
