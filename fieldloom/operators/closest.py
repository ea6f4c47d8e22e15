"""The nearest partners of each row within a reach, without the pairs of all rows in reach.

Rows stand in cells that are halved as long as they have many candidates. Of a cell's candidates those stay that can be among the nearest of any
row in it: a candidate is out if `most` others are nearer to every row of the cell than it is to any. So a row meets a few candidates
whatever the density, while pairs of a join within the reach grow with the square of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.operators.spatial import boxes_meeting
from fieldloom.operators.tables import Scratch

#: Candidates for each partner asked for with which a cell is not halved further, and the most halvings (they decide on time only).
FEW, HALVINGS = 12, 20
CELL, EDGES = ["_key", "_gx", "_gz"], ("min_x", "max_x", "min_z", "max_z")


def as_boxes(points: DataFrame) -> DataFrame:
    """Points (x, z) as boxes."""
    return points.withColumns({f"{m}_{a}": F.col(a).cast("double") for a in "xz" for m in ("min", "max")})


def _in_cells(rows: DataFrame, size: float, level: int) -> DataFrame:
    return rows.withColumns({f"_g{a}": F.floor(F.col(f"l.min_{a}") * 2.0**level / size) for a in "xz"})


def _bounds(rows: DataFrame) -> DataFrame:
    """The least and greatest edges of each cell's rows."""
    return rows.groupBy(*CELL).agg(*(f(f"l.{e}").alias(f"_{n}_{e}") for e in EDGES for n, f in (("low", F.min), ("high", F.max))))


def _gap(a: str, low: Column, high: Column) -> Column:
    """Gap along an axis between a candidate and a row whose lower edge is `low` and whose upper edge is `high`."""
    return F.greatest(F.lit(0.0), low - F.col(f"r.max_{a}"), F.col(f"r.min_{a}") - high)


def _measured(pairs: DataFrame) -> DataFrame:
    """The least and greatest distance between a candidate and the rows of a cell."""
    least = F.hypot(*(_gap(a, F.col(f"_low_min_{a}"), F.col(f"_high_max_{a}")) for a in "xz"))
    most = F.hypot(*(_gap(a, F.col(f"_high_min_{a}"), F.col(f"_low_max_{a}")) for a in "xz"))
    return pairs.withColumns({"_least": least, "_most": most})


def nearest_within(left: DataFrame, right: DataFrame, reach: float, most: int, same: dict[str, str] | None = None) -> DataFrame:
    """(l, r, distance, place): for each left row its `most` nearest right rows at most `reach` apart, by distance, then id; l and r are the rows.

    Rows are boxes (id, min_x, max_x, min_z, max_z) with any other columns. same: left columns by right columns that must be equal to them.
    """
    tables, same = Scratch(left.sparkSession), same or {}
    size = float(reach) if reach > 0 else 1.0
    key = lambda names: F.struct(F.lit(0).alias("_"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(names)))
    whole = lambda df, names, to: df.dropna(subset=[*EDGES, *names]).select(key(names).alias("_key"), F.struct(*df.columns).alias(to))
    # of right rows in one place only the first can be among the nearest
    place = Window.partitionBy(*same, *EDGES).orderBy("id")
    items = right.withColumn("_nth", F.row_number().over(place)).filter(F.col("_nth") <= most).drop("_nth")
    parts = 4 * left.sparkSession.sparkContext.defaultParallelism  # few bytes, but many candidates: small tables are spread too
    items = tables.saved(whole(items, list(same), "r").repartition(parts))
    rows = tables.saved(whole(left, list(same.values()), "l").repartition(parts))

    at, level, through = rows, 0, []
    cells = _bounds(_in_cells(at, size, 0)).withColumns({e: F.col(f"_{'low' if e.startswith('min') else 'high'}_{e}") for e in EDGES})
    met = boxes_meeting(cells, items.select("_key", "r", *(f"r.{e}" for e in EDGES)), float(reach), size).filter("l._key = r._key")
    pairs = met.select(*(F.col(f"l.{c}") for c in cells.columns if c not in EDGES), F.col("r.r").alias("r"))
    while True:
        met = tables.saved(_measured(pairs).filter(F.col("_least") <= reach))
        nth = F.row_number().over(Window.partitionBy(*CELL).orderBy("_most", "r.id"))
        last = met.select(*CELL, "_most", "r", nth.alias("_nth")).filter(F.col("_nth") == most).select(*CELL, F.struct("_most", "r.id").alias("_last"))
        kept = met.join(tables.saved(last), CELL, "left").filter(F.col("_last").isNull() | (F.struct("_least", "r.id") <= F.col("_last")))
        kept = tables.saved(kept.drop("_last", "_least", "_most"))
        one = reduce(Column.__and__, (F.col(f"_low_{e}") == F.col(f"_high_{e}") for e in EDGES))
        many = kept.groupBy(*CELL).agg(F.count("*").alias("_n"), F.first(one).alias("_one")).filter((F.col("_n") > FEW * most) & ~F.col("_one")).select(*CELL)
        many = tables.saved(many)
        tables.discard(met)
        if level == HALVINGS or many.isEmpty():
            through.append((level, at, kept.select(*CELL, "r")))
            break
        through.append((level, at, kept.select(*CELL, "r").join(many, CELL, "left_anti")))
        at = tables.saved(_in_cells(at, size, level).join(many, CELL, "left_semi").select("_key", "l"))
        level += 1
        cells = tables.saved(_bounds(_in_cells(at, size, level)))
        parent = cells.withColumns({f"_p{a}": F.floor(F.col(f"_g{a}") / 2) for a in "xz"})
        before = kept.select(F.col("_key"), F.col("_gx").alias("_px"), F.col("_gz").alias("_pz"), "r")
        pairs = parent.join(before, ["_key", "_px", "_pz"]).drop("_px", "_pz")

    found = reduce(DataFrame.union, (_in_cells(of, size, n).join(candidates, CELL).select("l", "r") for n, of, candidates in through))
    found = found.withColumn("distance", F.hypot(*(_gap(a, F.col(f"l.min_{a}"), F.col(f"l.max_{a}")) for a in "xz"))).filter(F.col("distance") <= reach)
    nth = F.row_number().over(Window.partitionBy("l.id", *(f"l.{c}" for c in same.values())).orderBy("distance", "r.id"))
    return found.withColumn("place", nth).filter(F.col("place") <= most)
