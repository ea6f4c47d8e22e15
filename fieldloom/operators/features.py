"""Feature-level operators: unions in source order, set reports, roofs, widths, colours, sign texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.aggregates import plane

#: Usual width in metres of a way, and how far to trust it.
WIDTH_PRIORS = {"queue": (2.0, 0.56), "pedestrian": (6.0, 0.5), "steps": (2.5, 0.5), "corridor": (2.0, 0.52), "sidewalk": (2.0, 0.54), "crossing": (3.0, 0.48), "cycleway": (3.0, 0.52), "track": (3.0, 0.45), "service": (4.0, 0.5)}
LANE_WIDTH = 3.0


def in_source_order(sources: list[DataFrame], id: str) -> DataFrame:
    """Rows of all sources; an id of an earlier source keeps out later ones. Adds source_order."""
    numbered = [s.withColumn("source_order", F.lit(i)) for i, s in enumerate(sources)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    first = whole.groupBy(id).agg(F.min("source_order").alias("source_order"))
    return whole.join(first, [id, "source_order"], "left_semi")


def set_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, n): how many distinct keys are in both, only left, only right."""
    sides = left.select(key, F.lit(1).alias("s")).union(right.select(key, F.lit(2).alias("s"))).groupBy(key).agg(F.bit_or("s").alias("s"))
    name = F.when(F.col("s") == 3, "both").when(F.col("s") == 1, "only left").otherwise("only right")
    return sides.groupBy(name.alias("side")).agg(F.count("*").alias("n"))


def roofs(samples: DataFrame, key: list[str], x: str, z: str, height: str) -> DataFrame:
    """Form of each roof: flat up to 0.6 m of relief (from the 20th to the 90th percentile), shed where a plane fits, pitched from 1.5 m, else complex."""
    spread = samples.groupBy(*key).agg(F.percentile(height, F.array(F.lit(0.2), F.lit(0.9))).alias("p"))
    fitted = plane(samples, key, x, z, height).join(spread, key).withColumn("relief", F.col("p")[1] - F.col("p")[0])
    form = F.when(F.col("n") < 4, "unresolved").when(F.col("relief") <= 0.6, "flat").when((F.col("r2") >= 0.55) & (F.col("relief") >= 1.5), "shed").when(F.col("relief") >= 1.5, "pitched").otherwise("complex")
    return fitted.withColumn("form", form).drop("p")


def width(stated: Column, lanes: Column, kind: Column) -> Column:
    """Width with status and trust: stated, by lanes, by kind, or unresolved."""
    value = lambda w, s, c: F.struct(w.cast("double").alias("width"), F.lit(s).alias("status"), c.cast("double").alias("confidence"))
    pick = lambda i: F.create_map(*(F.lit(x) for k, v in WIDTH_PRIORS.items() for x in (k, v[i])))[kind]
    return (
        F.when(stated.isNotNull(), value(stated, "stated", F.lit(0.9))).when(lanes.isNotNull(), value(lanes * LANE_WIDTH, "lanes", F.lit(0.6)))
        .when(pick(0).isNotNull(), value(pick(0), "prior", pick(1))).otherwise(value(F.lit(None), "unresolved", F.lit(None)))
    )


def observed_colour(pixels: DataFrame, key: list[str]) -> DataFrame:
    """Median colour of each group without its darkest fifth."""
    light = pixels.withColumn("_light", 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b"))
    dark = light.groupBy(*key).agg(F.percentile("_light", F.lit(0.2)).alias("_dark"))
    return light.join(dark, key).filter("_light >= _dark").groupBy(*key).agg(F.count("*").alias("n"), *(F.percentile(c, F.lit(0.5)).alias(c) for c in "rgb"))


def wrapped(text: Column, width: int, most: int) -> Column:
    """Lines of at most `width` characters broken between words, longer words hard; the last of too many ends in an ellipsis."""
    words = F.flatten(F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_extract_all(w, F.lit(f"(.{{1,{width}}})"), F.lit(1))))
    add = lambda lines, w: F.when((F.size(lines) > 0) & (F.length(F.element_at(lines, -1)) + 1 + F.length(w) <= width), F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat(F.element_at(lines, -1), F.lit(" "), w)))).otherwise(F.concat(lines, F.array(w)))
    lines = F.aggregate(words, F.array().cast("array<string>"), lambda s, w: F.when(F.size(s) == 0, F.array(w)).otherwise(add(s, w)))
    cut = F.concat(F.slice(lines, 1, most - 1), F.array(F.concat(F.substring(F.element_at(lines, most), 1, width - 1), F.lit("…"))))
    return F.when(F.size(lines) > most, cut).otherwise(lines)
