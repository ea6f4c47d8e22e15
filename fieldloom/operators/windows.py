"""Ranking, interval and gap operators. Every window is partitioned by a key of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve_priority(rows: DataFrame, key: list[str], priority: Column, confidence: Column, distance: Column, source: Column) -> DataFrame:
    """One row per key: highest priority, then confidence (null lowest), distance (null farthest), source; the rest is out."""
    by = Window.partitionBy(*key).orderBy(priority.desc(), F.coalesce(confidence, F.lit(-1.0)).desc(), F.coalesce(distance, F.lit(float("inf"))).asc(), source.asc())
    return rows.withColumn("rank", F.row_number().over(by))


def conflicts(ranked: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Losers whose value differs from their winner's by more than the tolerance."""
    won = F.max(F.when(F.col("rank") == 1, F.col(value))).over(Window.partitionBy(*key))
    return ranked.withColumn("won", won).filter((F.col("rank") > 1) & (F.abs(F.col(value) - F.col("won")) > tolerance))


def number_occurrences(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return number_occurrences(rows, key, order).filter("occurrence = 1").drop("occurrence")


def newest(rows: DataFrame, key: list[str], stamp: str, order: list[str]) -> DataFrame:
    """The latest row of each key; of equally late ones the first by `order`."""
    by = Window.partitionBy(*key).orderBy(F.col(stamp).desc_nulls_last(), *order)
    return rows.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def top_per_group(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("place") <= n)


def runs_of_equal(rows: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """Numbers maximal runs of equal states: `run` counts up within each key."""
    by = Window.partitionBy(*key).orderBy(*order)
    changed = F.when(F.lag(state).over(by).eqNullSafe(F.col(state)) & (F.row_number().over(by) > 1), 0).otherwise(1)
    return rows.withColumn("_new", changed).withColumn("run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def transitions(rows: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """Rows at which the state differs from the one before; the first row of a key is one."""
    by = Window.partitionBy(*key).orderBy(*order)
    rows = rows.withColumns({"before": F.lag(state).over(by), "_n": F.row_number().over(by)})
    return rows.filter((F.col("_n") == 1) | ~F.col("before").eqNullSafe(F.col(state))).drop("_n")


def spans(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    """Runs of consecutive whole positions with equal keys, as first and last position."""
    island = F.col(position) - F.row_number().over(Window.partitionBy(*key).orderBy(position))
    return rows.withColumn("_island", island).groupBy(*key, "_island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("_island")


def fill_gaps(rows: DataFrame, key: list[str], measure: str, value: str, longest: float) -> DataFrame:
    """Interpolates nulls between two known values at most `longest` apart; never beyond the known ones. Adds `filled` and `evidence`."""
    by = Window.partitionBy(*key).orderBy(measure)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(measure).alias("m"), F.col(value).alias("v")))
    rows = rows.withColumns({"_a": F.last(known, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first(known, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))})
    span = F.col("_b.m") - F.col("_a.m")
    inner = F.when(span <= longest, F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(measure) - F.col("_a.m")) / F.nullif(span, F.lit(0.0)))
    evidence = F.when(F.col(value).isNotNull(), "observed").when(inner.isNotNull(), "interpolated").otherwise("unresolved")
    return rows.withColumns({"filled": F.coalesce(F.col(value), inner), "evidence": evidence}).drop("_a", "_b")


def segments(rows: DataFrame, key: list[str], measure: str, value: str, longest: float) -> DataFrame:
    """Segments between neighbouring known values with their gradient; those longer than `longest` are unsupported."""
    by = Window.partitionBy(*key).orderBy(measure)
    known = rows.filter(F.col(value).isNotNull()).withColumns({"end_measure": F.lead(measure).over(by), "end_value": F.lead(value).over(by)})
    known = known.filter(F.col("end_measure") > F.col(measure))
    gradient = F.floor((F.col("end_value") - F.col(value)) / (F.col("end_measure") - F.col(measure)) * 1e6 + 0.5) / 1e6
    return known.select(*key, F.col(measure).alias("start_measure"), "end_measure", F.col(value).alias("start_value"), "end_value", gradient.alias("gradient"),
                        F.when(F.col("end_measure") - F.col(measure) > longest, "unsupported-gap").otherwise("supported").alias("status"))


def value_at(asked: DataFrame, known: DataFrame, key: list[str], at: str, bin: float = 64.0) -> DataFrame:
    """The value on the first segment that holds the asked measure; null outside all segments.

    Both sides meet in bins of the measure, so an asked row sees the segments near it, however many its line has.
    """
    asked = asked.withColumn("_bin", F.floor(F.col(at) / bin))
    near = known.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_measure") / bin), F.floor(F.col("end_measure") / bin))))
    met = asked.select(*key, at, "_bin").distinct().join(near, [*key, "_bin"]).filter(F.col(at).between(F.col("start_measure"), F.col("end_measure")))
    value = F.col("start_value") + (F.col("end_value") - F.col("start_value")) * (F.col(at) - F.col("start_measure")) / (F.col("end_measure") - F.col("start_measure"))
    best = met.groupBy(*key, at).agg(F.min_by(value, "start_measure").alias("value"))
    return asked.drop("_bin").join(best, [*key, at], "left")


def resample(lines: DataFrame, key: list[str], start: str, end: str, step: float) -> DataFrame:
    """Measures every `step` from start, and the end itself."""
    count = F.floor((F.col(end) - F.col(start)) / step).cast("int")
    steps = F.transform(F.sequence(F.lit(0), count), lambda i: F.col(start) + i * step)
    return lines.select(*key, F.explode(F.array_distinct(F.concat(steps, F.array(F.col(end))))).alias("measure"))


def fill_between_flags(rows: DataFrame, key: list[str], order: str, flag: str) -> DataFrame:
    """Everything from the first to the last flagged row is flagged."""
    at = F.when(F.col(flag), F.col(order))
    whole = Window.partitionBy(*key)
    return rows.withColumn("inside", F.coalesce(F.col(order).between(F.min(at).over(whole), F.max(at).over(whole)), F.lit(False)))
