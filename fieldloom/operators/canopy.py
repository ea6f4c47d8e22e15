"""Tree crowns from canopy heights: seeds, the canopy that is connected to each, and its reaches.

Canopy cells are labelled once for the whole raster (cells that touch at sides or corners), so a crown is never cut by a tile. Seeds find
their cell among the cells in reach by an equi-join on cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.numbers import half_up
from fieldloom.operators.regions import labelled

#: Least canopy height and the farthest that a seed lies from its canopy, in metres; of cells, the farthest.
LEAST_HEIGHT, FARTHEST, FARTHEST_CELLS = 2.0, 3.0, 1.75


def canopy_cells(samples: DataFrame, size: float = 1.0, least: float = LEAST_HEIGHT) -> DataFrame:
    """(gx, gz, x, z, canopy, base): the highest sample of each cell, first by z, then x; samples (x, z, canopy, base) lower than `least` are none."""
    least = max(0.5, least)
    at = F.struct("canopy", (-F.col("z")).alias("z"), (-F.col("x")).alias("x"), "base")
    near = lambda c: half_up(F.col(c) / size, 0).cast("long")
    kept = samples.filter(F.col("canopy") >= least).withColumns({"gx": near("x"), "gz": near("z")})
    best = kept.groupBy("gx", "gz").agg(F.max(at).alias("b"))
    return best.select("gx", "gz", (-F.col("b.x")).alias("x"), (-F.col("b.z")).alias("z"), "b.canopy", "b.base")


def crowns(trees: DataFrame, samples: DataFrame, key: str = "tree_id", size: float = 1.0, least: float = LEAST_HEIGHT, farthest: float = FARTHEST) -> DataFrame:
    """One row for each tree (key, x, z) with canopy in reach: reaches to the four sides, radii, offsets, highest canopy, base, area and cells.

    A tree's crown is the canopy connected to the nearest canopy cell within max(1.75 cells, `farthest`), nearest by distance, then z, then x. The base is the
    lower quartile of the bases known in it. Trees that stand in one canopy share its cells (`shared` trees).
    """
    size = max(0.25, size)
    cells = canopy_cells(samples, size, least)
    region = labelled(cells.select(F.col("gx").alias("x"), F.col("gz").alias("z")), corners=True).select(F.col("x").alias("gx"), F.col("z").alias("gz"), "region")
    reach = max(FARTHEST_CELLS * size, farthest)
    n = int(reach / size) + 1
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-n, n + 1) for b in range(-n, n + 1)))).alias("o")
    asked = trees.select(F.col(key).alias("_key"), F.col("x").cast("double").alias("tx"), F.col("z").cast("double").alias("tz"))
    asked = asked.select("*", around).select("_key", "tx", "tz", (half_up(F.col("tx") / size, 0).cast("long") + F.col("o.a")).alias("gx"), (half_up(F.col("tz") / size, 0).cast("long") + F.col("o.b")).alias("gz"))
    gap = F.sqrt(F.pow(F.col("x") - F.col("tx"), F.lit(2)) + F.pow(F.col("z") - F.col("tz"), F.lit(2)))
    met = asked.join(cells, ["gx", "gz"]).withColumn("gap", gap).filter(F.col("gap") <= reach)
    seeds = met.groupBy("_key", "tx", "tz").agg(F.min(F.struct("gap", "z", "x", "gx", "gz")).alias("s")).select("_key", "tx", "tz", "s.gx", "s.gz").join(region, ["gx", "gz"])
    half = size / 2
    shapes = cells.join(region, ["gx", "gz"]).groupBy("region").agg(
        (F.min("x") - half).alias("x1"), (F.max("x") + half).alias("x2"), (F.min("z") - half).alias("z1"), (F.max("z") + half).alias("z2"),
        F.max("canopy").alias("max_canopy"), F.percentile("base", F.lit(0.25)).alias("crown_base"), F.count("*").alias("cells"),
    )
    shared = seeds.groupBy("region").agg(F.count("*").alias("shared"))
    side = lambda gap: F.greatest(F.lit(half), gap)
    out = seeds.join(shapes, "region").join(shared, "region").select(
        "_key", "cells", "shared", "max_canopy", "crown_base",
        side(F.col("tx") - F.col("x1")).alias("west"), side(F.col("x2") - F.col("tx")).alias("east"), side(F.col("tz") - F.col("z1")).alias("north"), side(F.col("z2") - F.col("tz")).alias("south"),
    )
    radius: dict[str, Column] = {"radius_x": (F.col("east") + F.col("west")) / 2, "radius_z": (F.col("north") + F.col("south")) / 2, "offset_x": (F.col("east") - F.col("west")) / 2, "offset_z": (F.col("south") - F.col("north")) / 2}
    out = out.withColumns(radius)
    skew = F.least(F.lit(1.0), F.sqrt(F.pow("offset_x", F.lit(2)) + F.pow("offset_z", F.lit(2))) / F.greatest(F.lit(0.5), "radius_x", "radius_z"))
    out = out.withColumns({"asymmetry": skew, "area": F.col("cells") * (size * size)})
    measures = ["west", "east", "north", "south", *radius, "max_canopy", "crown_base", "asymmetry", "area"]
    return out.select(F.col("_key").alias(key), *(half_up(F.col(c), 3).alias(c) for c in measures), "cells", "shared")
