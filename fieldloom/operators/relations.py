"""Typed relations between nodes with bounds, and building and profile measures from samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.operators.closest import nearest_within

#: Type, kinds of the two ends, reach in metres, partners at most, priority, scale of the confidence.
RELATIONS = (
    ("supports-ride", "ride-support", "ride-track", 30.0, 1, 100, 30.0),
    ("attachment-follows-ride", "ride-attachment", "ride-track", 20.0, 1, 98, 20.0),
    ("bridge-crosses-water", "bridge", "water", 0.0, 2, 95, 10.0),
    ("path-connects-building", "building", "path", 12.0, 3, 85, 12.0),
    ("barrier-bounds-path", "barrier", "path", 5.0, 2, 80, 10.0),
    ("ride-near-building", "ride-track", "building", 10.0, 4, 70, 10.0),
    ("path-interacts-ride", "path", "ride-track", 4.0, 2, 65, 10.0),
)


def inferred(nodes: DataFrame, size: float = 64.0) -> DataFrame:
    """Edges of all relation types among nodes (id, type, min_x .. max_z, base, confidence), nearest partners first.

    All relations are searched at once, in the widest reach and for the most partners; each then keeps its own. size: unused, cells follow the data.
    """
    of = lambda end: nodes.withColumn("relation", F.explode(F.array_compact(F.array(*(F.when(F.col("type") == rule[end], rule[0]) for rule in RELATIONS)))))
    near = nearest_within(of(1), of(2), max(r[3] for r in RELATIONS), max(r[4] for r in RELATIONS), {"relation": "relation"})
    rule = lambda i: F.element_at(F.create_map(*(F.lit(v) for r in RELATIONS for v in (r[0], r[i]))), F.col("l.relation"))
    near = near.filter((F.col("distance") <= rule(3)) & (F.col("place") <= rule(4)))
    trust = F.least(F.coalesce("l.confidence", F.lit(0.8)), F.coalesce("r.confidence", F.lit(0.8))) * F.greatest(F.lit(0.35), 1 - F.col("distance") / rule(6))
    step = F.col("r.base") - F.col("l.base")
    level = F.when(step.isNull(), "unresolved").when(F.abs(step) < 0.75, "same-level").when(step > 0, "above").otherwise("below")
    turned = F.col("l.relation") == "path-connects-building"
    ends = [F.when(turned, F.col(f"{b}.id")).otherwise(F.col(f"{a}.id")).alias(c) for a, b, c in (("l", "r", "from_id"), ("r", "l", "to_id"))]
    return near.select(F.col("l.relation").alias("type"), *ends, rule(5).alias("priority"), F.col("distance").alias("distance_m"), level.alias("vertical"), (F.floor(trust * 1000 + 0.5) / 1000).alias("confidence"))


def building_heights(samples: DataFrame, id: str, surface: str, terrain: str) -> DataFrame:
    """Height of each building from surface less terrain (1.5 to 80 m): 65th percentile, spread, coverage, confidence."""
    rise = F.col(surface) - F.col(terrain)
    seen = samples.groupBy(id).agg(F.count("*").alias("cells"), F.count_if(rise.between(1.5, 80)).cast("int").alias("n"), F.percentile(F.when(rise.between(1.5, 80), rise), F.array(F.lit(0.1), F.lit(0.65), F.lit(0.9))).alias("_p"))
    share = F.col("n") / F.col("cells")
    good = (F.col("n") >= 4) & (share >= 0.35)
    height, spread = F.floor(F.col("_p")[1] * 10 + 0.5) / 10, F.floor((F.col("_p")[2] - F.col("_p")[0]) * 10 + 0.5) / 10
    trust = 0.45 + 0.25 * share + 0.2 * F.least(F.lit(1.0), F.log2(F.col("n") + 1) / 7) + 0.1 * F.greatest(F.lit(0.0), 1 - spread / F.greatest(F.lit(6.0), height))
    return seen.select(id, "n", F.when(good, height).alias("height"), F.when(good, spread).alias("spread"), F.when(good, F.least(F.lit(0.99), F.floor(trust * 1000 + 0.5) / 1000)).alias("confidence"))


def height_candidates(points: DataFrame, key: list[str], elevation: str, ground: str, most: int = 8) -> DataFrame:
    """Half-metre clusters of heights above ground (0.45 to 80 m) with quality; the best `most` of each key."""
    above = points.withColumn("_h", F.col(elevation) - F.col(ground)).filter(F.col("_h").between(0.45, 80))
    bins = above.groupBy(*key, F.floor(F.col("_h") / 0.5 + 0.5).alias("bin")).agg(F.count("*").alias("n"), F.percentile("_h", F.lit(0.5)).alias("height"), F.avg(F.when(F.col("class").isin(0, 1), 1.0).otherwise(0.0)).alias("unclassified"))
    quality = 1.35 * F.log2(F.col("n") + 1) + 0.35 * F.col("unclassified") - 0.008 * F.col("height")
    bins = bins.withColumn("quality", F.floor(quality * 1e6 + 0.5) / 1e6)
    return bins.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("quality"), "bin"))).filter(F.col("place") <= most)


def prominent_maxima(cells: DataFrame, value: str, least: float, prominence: float = 1.25, ring: int = 2) -> DataFrame:
    """Local maxima that rise above the 65th percentile of the ring of cells `ring` away; where that is empty, above `least`."""
    from fieldloom.operators.raster import local_maxima, sent

    around = [(a, b) for a in range(-ring, ring + 1) for b in range(-ring, ring + 1) if max(abs(a), abs(b)) >= 2]
    level = sent(cells, around, value).groupBy("x", "z").agg(F.percentile(value, F.lit(0.65)).alias("_ring"))
    top = local_maxima(cells, value, least).join(level, ["x", "z"], "left").withColumn("prominence", F.col(value) - F.coalesce("_ring", F.lit(least)))
    return top.filter(F.col("prominence") >= prominence).drop("_ring")


def label_score(distance: Column, priority: Column, contained: Column, red: Column) -> Column:
    """Score of a label for a shape; the least wins."""
    return distance - 0.08 * priority - F.when(contained, 28).otherwise(0) - F.when(red, 35).otherwise(0)
