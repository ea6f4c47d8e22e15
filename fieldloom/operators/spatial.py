"""Joins in space and identity.

Joins within a distance are equi-joins on grid cells: one side is put into the cells its
reach touches, the other stays in its own, so no pair of far rows is ever formed and Catalyst
picks the join. A limit on partners is part of the operator asked for, not a safeguard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def pairs_within(left: DataFrame, right: DataFrame, reach: float, size: float | None = None, same: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points (l.id, l.x, l.z; r.id, r.x, r.z) at most `reach` apart, with `distance`.

    same: columns in which both sides agree.
    """
    size = size or max(reach, 1e-9)
    far = left.withColumns({"_cx": F.explode(_cells(F.col("x") - reach, F.col("x") + reach, size))})
    far = far.withColumn("_cz", F.explode(_cells(F.col("z") - reach, F.col("z") + reach, size)))
    near = right.withColumns({"_cx": F.floor(F.col("x") / size), "_cz": F.floor(F.col("z") / size)})
    on = [F.col("l._cx") == F.col("r._cx"), F.col("l._cz") == F.col("r._cz"), *(F.col(f"l.{c}") == F.col(f"r.{c}") for c in same)]
    both = far.alias("l").join(near.alias("r"), on)
    distance = F.hypot(F.col("l.x") - F.col("r.x"), F.col("l.z") - F.col("r.z"))
    return both.withColumn("distance", distance).filter(F.col("distance") <= reach)


#: Kinds of named places.
PLACES = ("attraction", "amenity", "detail")


def new_places(found: DataFrame, existing: DataFrame, tolerance: float) -> DataFrame:
    """Found points (id, name, x, z) without those that an existing place (kind in PLACES) of the same name lies near: ten metres or four tolerances."""
    said = lambda df: df.withColumn("_name", F.lower("name"))
    near = pairs_within(said(found), said(existing.filter(F.col("kind").isin(*PLACES) & (F.coalesce("name", F.lit("")) != ""))), max(10.0, 4 * tolerance), same=("_name",))
    return found.join(near.select(F.col("l.id").alias("id")).distinct(), "id", "left_anti")


def nearest(pairs: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """At most `most` pairs for each `by`, the first in order; adds `place`."""
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= most)


def boxes_meeting(left: DataFrame, right: DataFrame, tolerance: float, size: float) -> DataFrame:
    """Pairs of boxes (min_x, min_z, max_x, max_z) that meet when one is widened by the tolerance."""
    def spread(df: DataFrame, wide: float) -> DataFrame:
        df = df.withColumn("_cx", F.explode(_cells(F.col("min_x") - wide, F.col("max_x") + wide, size)))
        return df.withColumn("_cz", F.explode(_cells(F.col("min_z") - wide, F.col("max_z") + wide, size)))

    both = spread(left, tolerance).alias("l").join(spread(right, 0.0).alias("r"), [F.col("l._cx") == F.col("r._cx"), F.col("l._cz") == F.col("r._cz")])
    meets = [F.col(f"l.min_{a}") - tolerance <= F.col(f"r.max_{a}") for a in "xz"] + [F.col(f"r.min_{a}") <= F.col(f"l.max_{a}") + tolerance for a in "xz"]
    out = both
    for m in meets:
        out = out.filter(m)
    # a pair is taken in the first cell that both reach
    first = [F.col(f"l._c{a}") == F.greatest(F.floor((F.col(f"l.min_{a}") - tolerance) / size), F.floor(F.col(f"r.min_{a}") / size)) for a in "xz"]
    return out.filter(first[0] & first[1])


def replaced(base: DataFrame, changes: DataFrame, id: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Base rows without those that changes name in `target`, plus the changes; and changes whose target is missing."""
    gone = changes.select(F.col(target).alias(id)).filter(F.col(id).isNotNull()).distinct()
    stay = base.join(gone, id, "left_anti")
    missing = changes.filter(F.col(target).isNotNull()).join(base.select(F.col(id).alias(target)), target, "left_anti")
    return stay.unionByName(changes.drop(target), allowMissingColumns=True), missing


def limited_fanout(matches: DataFrame, key: str, most: int) -> DataFrame:
    """Matches of keys that have at most `most` of them; keys beyond are left out whole."""
    few = matches.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") <= most).select(key)
    return matches.join(few, key, "left_semi")


def linear_reference(rows: DataFrame, segments: DataFrame, key: list[str], reach: float) -> DataFrame:
    """For each point the nearest segment of its line within reach, with measure and lateral distance; ties take the lower measure.

    Segments are cut into pieces as long as a cell of the grid, which are put into the cells that their reach touches; points
    meet the pieces in their own cell, never all segments of a line.
    """
    cell = 2 * reach
    pieces = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("bz") - F.col("az")) / cell)).cast("int")
    cut = segments.withColumns({"_pieces": pieces}).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    end = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_pieces")
    for axis in "xz":
        a, b = end(f"a{axis}", f"b{axis}", F.col("_k")), end(f"a{axis}", f"b{axis}", F.col("_k") + 1)
        cut = cut.withColumn(f"_c{axis}", F.explode(_cells(F.least(a, b) - reach, F.greatest(a, b) + reach, cell)))
    placed = rows.withColumns({f"_c{axis}": F.floor(F.col(axis) / cell) for axis in "xz"})
    near = cut.select(*key, "_cx", "_cz", "ax", "az", "bx", "bz", "start").distinct()

    def measured(points: DataFrame) -> DataFrame:
        met = points.alias("p").join(near.alias("s"), [*key, "_cx", "_cz"])
        dx, dz = F.col("s.bx") - F.col("s.ax"), F.col("s.bz") - F.col("s.az")
        size = dx * dx + dz * dz
        along = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("p.x") - F.col("s.ax")) * dx + (F.col("p.z") - F.col("s.az")) * dz) / F.nullif(size, F.lit(0.0)))))
        met = met.withColumn("lateral", F.hypot(F.col("p.x") - (F.col("s.ax") + along * dx), F.col("p.z") - (F.col("s.az") + along * dz)))
        return met.withColumn("measure", F.col("s.start") + along * F.sqrt(size)).filter(F.col("lateral") <= reach)

    # the least of a number is kept by hashing; the least of a struct would sort all that the points meet
    best = measured(placed).groupBy("p.id").agg(F.min("lateral").alias("_best"))
    ties = measured(placed.join(best, "id")).filter(F.col("lateral") == F.col("p._best"))
    return ties.groupBy("p.id").agg(F.min("lateral").alias("lateral"), F.min("measure").alias("measure"))


def overlap_decision(samples: DataFrame, existing: DataFrame, id: str, tolerance: float, same: tuple[str, ...] = ()) -> DataFrame:
    """duplicate, partial or accept for each line by the share of its samples within the tolerance of existing points."""
    hit = pairs_within(samples.withColumn("_s", F.struct(id, "n")), existing, tolerance, same=same).select(F.col("l._s").alias("_s")).distinct()
    marked = samples.withColumn("_s", F.struct(id, "n")).join(hit.withColumn("_hit", F.lit(1)), "_s", "left")
    share = F.sum(F.coalesce("_hit", F.lit(0))) / F.count("*")
    decided = marked.groupBy(id).agg(share.alias("share"))
    return decided.withColumn("decision", F.when(F.col("share") >= 0.8, "duplicate").when(F.col("share") >= 0.2, "partial").otherwise("accept"))


def shard_of(position: Column, shards: int) -> Column:
    return F.pmod(position, F.lit(shards)).cast("int")


def shard_problems(planned: DataFrame, prepared: DataFrame, id: str, shards: int) -> DataFrame:
    """Rows (problem, id): entries that are missing, unplanned, repeated, or in a shard that is not theirs."""
    want = planned.select(F.col(id), shard_of(F.col("position"), shards).alias("_want"))
    got = prepared.select(id, "shard")
    many = got.groupBy(id).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("repeated").alias("problem"), id)
    both = want.join(got.groupBy(id).agg(F.collect_set("shard").alias("_in")), id, "full")
    found = both.withColumn("problem", F.when(F.col("_in").isNull(), "missing").when(F.col("_want").isNull(), "unplanned").when(F.size(F.array_except("_in", F.array("_want"))) > 0, "misplaced"))
    return found.filter("problem is not null").select("problem", id).unionByName(many)
