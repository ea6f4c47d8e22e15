"""Path repair, entrances, labels, ordered anchors, corroboration and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.operators.closest import as_boxes, nearest_within
from fieldloom.operators.spatial import nearest, pairs_within


def gap_repairs(ends: DataFrame, tolerance: float, least: float = 0.2) -> DataFrame:
    """For each line end (id, line, x, z, role, level) the nearest end of another line of the same level within the tolerance.

    Queues join queues only, service ways service ways; equal roles count more. Confidence as for a gap of that width.
    """
    pairs = pairs_within(ends, ends, tolerance).filter("l.line <> r.line and distance >= " + str(least))
    pairs = pairs.filter(F.col("l.level").eqNullSafe(F.col("r.level")))
    strict = F.col("l.role").isin("queue", "service") | F.col("r.role").isin("queue", "service")
    pairs = pairs.filter(~strict | (F.col("l.role") == F.col("r.role")))
    fit = F.when(F.col("l.role") == F.col("r.role"), 1.0).otherwise(0.7)
    trust = F.floor(F.least(F.lit(0.96), 0.62 + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("distance") / tolerance) + 0.04 * fit) * 1000 + 0.5) / 1000
    rows = pairs.select(F.col("l.id").alias("id"), F.col("r.id").alias("to_id"), "distance", trust.alias("confidence"))
    return nearest(rows, "id", [F.asc("distance"), F.asc("to_id")], 1).drop("place").withColumn("accepted", F.col("confidence") >= 0.72)


def entrances(doors: DataFrame, buildings: DataFrame, reach: float = 8.0) -> DataFrame:
    """The building nearest each entrance (id, x, z, rank), then the entrance of highest rank of each building."""
    near = nearest_within(as_boxes(doors), as_boxes(buildings), reach, 1).select(F.col("l.id").alias("door"), F.col("l.rank").alias("rank"), F.col("r.id").alias("building"), "distance")
    return nearest(near, "building", [F.desc("rank"), F.asc("door")], 1).drop("place")


def labelled(labels: DataFrame, shapes: DataFrame, reach: float, most: int) -> DataFrame:
    """The best label for each shape by distance less priority; labels that meet more than `most` shapes are out."""
    met = nearest_within(as_boxes(labels), as_boxes(shapes), reach, most + 1)  # one more than allowed tells who meets too many
    met = met.withColumn("n", F.max("place").over(Window.partitionBy("l.id"))).filter(F.col("n") <= most)
    met = met.select(F.col("l.id").alias("label"), F.col("r.id").alias("shape"), (F.col("distance") - 0.08 * F.col("l.priority")).alias("score"))
    return nearest(met, "shape", [F.asc("score"), F.asc("label")], 1).drop("place")


def thinned(anchors: DataFrame, key: str, measure: str, order: list[Column], apart: float) -> DataFrame:
    """Anchors of each line in order of measure without those closer than `apart` to the last one kept."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(measure).alias("m"), *(c.alias(f"o{i}") for i, c in enumerate(order)))))  # one line's anchors
    step = lambda kept, a: F.when((F.size(kept) > 0) & (a.m - F.element_at(kept, -1).m < apart), kept).otherwise(F.concat(kept, F.array(a)))
    lists = anchors.groupBy(key).agg(rows.alias("a"))
    return lists.select(key, F.explode(F.aggregate("a", F.slice("a", 1, 0), step)).alias("a")).select(key, "a.*").withColumnRenamed("m", measure)


def tunnel_elevations(rows: DataFrame, key: list[str], measure: str, value: str, ground: str, cover: float) -> DataFrame:
    """Nulls between known values take the line between them, but at most the ground less the cover."""
    by = Window.partitionBy(*key).orderBy(measure)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(measure).alias("m"), F.col(value).alias("v")))
    rows = rows.withColumns({"_a": F.last(known, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first(known, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))})
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(measure) - F.col("_a.m")) / F.nullif(F.col("_b.m") - F.col("_a.m"), F.lit(0.0))
    return rows.withColumn("filled", F.coalesce(F.col(value), F.when(line.isNotNull(), F.least(line, F.col(ground) - cover)))).drop("_a", "_b")


def corroborated(samples: DataFrame, evidence: DataFrame, id: str, reach: float, least: int, share: float) -> DataFrame:
    """Whether enough samples (id, n, x, z) of each feature have evidence (x, z) within reach."""
    hit = pairs_within(samples, evidence, reach).select(F.col(f"l.{id}").alias(id), F.col("l.n").alias("n")).distinct().groupBy(id).agg(F.count("*").alias("hits"))
    seen = samples.groupBy(id).agg(F.count("*").alias("samples")).join(hit, id, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return seen.withColumn("corroborated", (F.col("samples") >= least) & (F.col("hits") / F.col("samples") >= share))


def grades(rows: DataFrame, key: list[str], measure: str, elevation: str) -> DataFrame:
    """90th percentile of the grade between neighbouring samples: steep beyond 16 %, a ramp beyond 8.3 %."""
    by = Window.partitionBy(*key).orderBy(measure)
    run, rise = F.col(measure) - F.lag(measure).over(by), F.abs(F.col(elevation) - F.lag(elevation).over(by))
    steps = rows.filter(F.col(elevation).isNotNull()).withColumns({"_run": run, "_rise": rise}).filter("_run > 0")
    seen = steps.groupBy(*key).agg(F.percentile(100 * F.col("_rise") / F.col("_run"), F.lit(0.9)).alias("p90"), F.count("*").alias("n"))
    return seen.withColumn("status", F.when(F.col("p90") > 16, "steep").when(F.col("p90") > 8.3, "ramp").otherwise("level"))


def robust_widths(sections: DataFrame, key: list[str], width: str, least: int = 3) -> DataFrame:
    """Median width and median absolute deviation of a route's sections; sections beyond max(1.5, 3 deviations, 0.4 widths) are out."""
    middle = sections.groupBy(*key).agg(F.percentile(width, F.lit(0.5)).alias("_m"))
    off = sections.join(middle, key).withColumn("_off", F.abs(F.col(width) - F.col("_m")))
    spread = off.groupBy(*key).agg(F.percentile("_off", F.lit(0.5)).alias("deviation"))
    good = off.join(spread, key).filter(F.col("_off") <= F.greatest(F.lit(1.5), 3 * F.col("deviation"), 0.4 * F.col("_m")))
    return good.groupBy(*key, "deviation").agg(F.count("*").alias("n"), F.percentile(width, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_p")).select(*key, "n", "deviation", F.col("_p")[1].alias("width"), (F.col("_p")[2] - F.col("_p")[0]).alias("range"), (F.col("n") >= least).alias("accepted"))
