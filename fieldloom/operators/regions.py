"""Regions of cells, rings from loose ways, voxel lines and their precedence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.graphs import components
from fieldloom.operators.raster import sent


def labelled(cells: DataFrame, corners: bool = False) -> DataFrame:
    """Cells with the region they belong to by sides (or also corners) that touch: the region's least cell key."""
    key = lambda x, z: F.format_string("%020d:%020d", F.col(z) + (1 << 40), F.col(x) + (1 << 40))
    own = cells.select("x", "z").distinct().withColumn("cell", key("x", "z"))
    beside = sent(own, [(1, 0), (0, 1), *([(1, 1), (1, -1)] if corners else [])], F.col("cell").alias("a")).join(own, ["x", "z"])
    roots = components(beside.select("a", F.col("cell").alias("b")))
    return own.join(roots, F.expr("cell = node"), "left").select("x", "z", F.coalesce("root", "cell").alias("region"))


def large_regions(cells: DataFrame, least: int) -> DataFrame:
    """Region sizes and bounds of at least `least` cells."""
    return labelled(cells).groupBy("region").agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in "xz" for f in (F.min, F.max))).filter(F.col("n") >= least)


def stitch(ways: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings from ways that meet at their ends, in any direction; ways that close no ring are left out."""
    left, rings = [list(w) for w in ways if len(w) > 1], []
    while left:
        ring = left.pop(0)
        while ring[0] != ring[-1]:
            for i, way in enumerate(left):
                if way[0] == ring[-1]:
                    ring += left.pop(i)[1:]
                    break
                if way[-1] == ring[-1]:
                    ring += left.pop(i)[-2::-1]
                    break
            else:
                break
        if ring[0] == ring[-1] and len(ring) > 3:
            rings.append(ring)
    return rings


def rings(ways: DataFrame, key: str) -> DataFrame:
    """Rings (key, ring, seq, x, z) of each relation's ways (key, way, seq, x, z)."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = [list(zip(w["x"], w["z"])) for _, w in group.sort_values(["way", "seq"], kind="stable").groupby("way", sort=True)]
        k = group[key].iloc[0]
        return pd.DataFrame([(k, r, i, x, z) for r, ring in enumerate(stitch(parts)) for i, (x, z) in enumerate(ring)], columns=[key, "ring", "seq", "x", "z"])

    kind = ways.schema[key].dataType.simpleString()
    return ways.groupBy(key).applyInPandas(run, f"{key} {kind}, ring int, seq int, x double, z double")


def voxel_line(x0: Column, y0: Column, z0: Column, x1: Column, y1: Column, z1: Column) -> Column:
    """Whole cells along a segment, one for each step of its longest axis, neighbours that repeat left out."""
    steps = F.greatest(F.abs(x1 - x0), F.abs(y1 - y0), F.abs(z1 - z0)).cast("int")
    at = lambda a, b, i: F.floor(a + (b - a) * i / F.greatest(steps, F.lit(1)) + 0.5).cast("bigint")
    cells = F.transform(F.sequence(F.lit(0), steps), lambda i: F.struct(at(x0, x1, i).alias("x"), at(y0, y1, i).alias("y"), at(z0, z1, i).alias("z")))
    return F.filter(cells, lambda c, i: (i == 0) | (c != F.element_at(cells, F.greatest(i, F.lit(1)))))


def precedence(voxels: DataFrame, rank: Column, order: str) -> DataFrame:
    """One row per cell: the highest rank, of equal ones the last written."""
    rest = [c for c in voxels.columns if c not in ("x", "y", "z")]
    return voxels.groupBy("x", "y", "z").agg(F.max_by(F.struct(*rest), F.struct(rank, F.col(order))).alias("v")).select("x", "y", "z", "v.*")
