"""Surfaces and stands seen in samples: materials, patches, prototypes, vegetation, species and ride profiles of a key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import colour
from fieldloom.functions.numbers import clamp, half_up

#: Surfaces of rock, and sources of heights that are no ride's own.
ROCK_SURFACES = ("bare_rock", "scree", "quarry", "shingle", "rock", "stone", "outcrop")
TERRAIN_SOURCE = r"(?i)terrain|dtm|base-sampler|ground-associated"


def rock_surface(subtype: Column) -> Column:
    return F.coalesce(F.lower(subtype).isin(*ROCK_SURFACES), F.lit(False))


def ride_elevation(elevation: Column, explicit: Column, source: Column) -> Column:
    """A ride's own elevation; null unless it is explicit and no terrain's."""
    return F.when(F.coalesce(explicit, F.lit(False)) & ~F.coalesce(source, F.lit("")).rlike(TERRAIN_SOURCE), elevation)


def in_envelope(dx: Column, dy: Column, dz: Column, radius: Column, above: Column, below: Column) -> Column:
    """Whether a point lies in the ellipsoid around a ride, half a block wider than stated, with its own reach up and down."""
    up = F.when(dy >= 0, above).otherwise(below) + 0.5
    return (dx * dx + dz * dz) / F.pow(radius + 0.5, 2) + dy * dy / F.pow(up, 2) <= 1


def in_crown(dx: Column, dz: Column, geometry: Column, tolerance: float = 0.12) -> Column:
    x, z = (dx - geometry["offset_x"]) / F.greatest(F.lit(0.5), geometry["radius_x"]), (dz - geometry["offset_z"]) / F.greatest(F.lit(0.5), geometry["radius_z"])
    return x * x + z * z <= 1 + tolerance


def saturation(r: Column, g: Column, b: Column) -> Column:
    most = F.greatest(r, g, b)
    return F.when(most > 0, (most - F.least(r, g, b)) / most).otherwise(0.0)


def with_texture(samples: DataFrame, key: str) -> DataFrame:
    """One row for each key: n, the median colour (r, g, b) and texture, the mean difference from it. Medians are of bytes, 256 values a key at most."""
    centre = samples.groupBy(key).agg(F.count("*").alias("n"), *(F.median(c).alias(f"m{c}") for c in "rgb"))
    own, mid = (colour.lab(*(F.col(p + c) for c in "rgb")) for p in ("", "m"))
    apart = samples.join(centre, key).groupBy(key).agg(F.avg(colour.difference(own, mid)).alias("texture"))
    return centre.join(apart, key).select(key, "n", *(F.col(f"m{c}").alias(c) for c in "rgb"), "texture")


def material(seen: DataFrame, metres: float) -> DataFrame:
    """Adds the material of a surface and the trust in it, from n, r, g, b and texture at a resolution in metres; null below 8 samples."""
    r, g, b, texture = (F.col(c) for c in ("r", "g", "b", "texture"))
    seen = seen.withColumns({"_light": colour.lab(r, g, b)[0], "_tone": saturation(r, g, b)})
    light, tone, fine = F.col("_light"), F.col("_tone"), 0.5 - metres
    warm = (r > g * 1.13) & (g > b * 1.12) & tone.between(0.18, 0.62) & light.between(28, 68)
    rules = [
        ("asphalt", (tone < 0.2) & (light < 52) & (texture < 14), clamp(0.84 + fine * 0.08 - texture / 180, 0.68, 0.92)),
        ("concrete", (tone < 0.18) & (light >= 52) & (light < 86) & (texture < 12), clamp(0.83 + fine * 0.06 - texture / 180, 0.67, 0.9)),
        ("gravel", (tone < 0.24) & (texture > 18), clamp(F.lit(0.72 + fine * 0.08), 0.58, 0.8)),
        ("earth", warm, clamp(0.74 + clamp(1 - F.abs(texture - 10) / 18, 0.0, 1.0) * 0.12 + fine * 0.05, 0.68, 0.88)),
        ("paving_stones", (r > g * 1.15) & (g > b * 1.05) & F.lit(metres <= 0.35), F.lit(0.7)),
    ]
    name, sure = F.lit(None).cast("string"), F.lit(0.0)
    for n, rule, trust in reversed(rules):
        name, sure = F.when(rule, n).otherwise(name), F.when(rule, trust).otherwise(sure)
    solid = (texture < 7) & F.lit(metres <= 0.6)
    return seen.withColumns({
        "material": F.when(F.col("n") >= 8, name), "trust": F.when(F.col("n") >= 8, half_up(sure, 3)), "pattern": F.when((F.col("n") >= 8) & solid, "solid"),
    }).drop("_light", "_tone")


def patch(pixels: DataFrame) -> DataFrame:
    """Adds the class of a patch and the trust in it, from its colour (r, g, b) and texture: the first rule that fits."""
    r, g, b, texture = (F.col(c) for c in ("r", "g", "b", "texture"))
    linear = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, 2.4))
    pixels = pixels.withColumns({
        "_light": 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b), "_tone": saturation(r, g, b), "_green": (g - (r + b) / 2) / 255, "_blue": (b - (r + g) / 2) / 255, "_warm": (r - b) / 255, "_dry": (F.least(r, g) - b) / 255,
    })
    light, tone, green, blue, warm, dry = (F.col(f"_{c}") for c in ("light", "tone", "green", "blue", "warm", "dry"))
    leafy, dense = (green > 0.075) & (g > 48), (texture >= 8) | (light < 0.34) | (tone > 0.42)
    rules = [
        ("shadow", light < 0.045, F.lit(0.88)), ("water-candidate", (blue > 0.1) & (b > 55) & (light < 0.58), 0.64 + blue * 1.6),
        ("dense-tree-canopy", leafy & dense, 0.72 + green * 1.45 + F.least(F.lit(0.12), texture / 120)), ("grass", leafy & (light > 0.42), 0.7 + green * 1.35), ("vegetation", leafy, 0.7 + green * 1.35),
        ("soil-mulch", (r > g * 1.06) & (g > b * 1.04) & (warm > 0.08) & light.between(0.12, 0.62), 0.69 + F.least(F.lit(0.14), warm * 0.7) + F.least(F.lit(0.08), texture / 160)),
        ("dry-grass", (dry > 0.08) & (warm > 0.04) & (light > 0.24) & (g >= r * 0.84), 0.67 + dry * 1.2), ("rock-gravel", (tone < 0.2) & (texture >= 8) & light.between(0.16, 0.72), 0.66 + F.least(F.lit(0.16), texture / 100)),
        ("sand", (warm > 0.03) & (tone < 0.28) & (light > 0.62), 0.66 + F.least(F.lit(0.16), light * 0.16)), ("neutral-hardscape-candidate", (tone < 0.2) & (light > 0.08) & (light < 0.84), 0.68 - tone * 0.5),
    ]
    name, sure = F.lit("unclassified"), F.lit(0.35)
    for n, rule, trust in reversed(rules):
        name, sure = F.when(rule, n).otherwise(name), F.when(rule, trust).otherwise(sure)
    return pixels.withColumns({"class": name, "trust": half_up(clamp(sure, 0.0, 0.99), 3)}).drop("_light", "_tone", "_green", "_blue", "_warm", "_dry")


def appearance(cells: DataFrame, key: str, prototype: str) -> DataFrame:
    """The prototype most cells of a key have (of equals the least) and their median colour; two counts, no list of cells."""
    counted = cells.filter(F.col(prototype).isNotNull()).groupBy(key, prototype).agg(F.count("*").alias("n"))
    best = counted.groupBy(key).agg(F.min_by(prototype, F.struct(-F.col("n"), F.col(prototype))).alias(prototype))
    seen = cells.groupBy(key).agg(*(F.floor(F.median(c) + 0.5).cast("long").alias(c) for c in "rgb"))
    return seen.join(best, key, "left")


def vegetation(samples: DataFrame, key: list[str]) -> DataFrame:
    """Ground, canopy, height, crown and class of each plant: samples with ground, surface, and the key's stated height, crown area and words.

    Ground is the median, canopy the 90th percentile; a stated height comes first, and stands on the ground where no canopy is seen.
    """
    c = F.col
    got = samples.groupBy(*key).agg(F.median("ground").alias("ground"), F.percentile("surface", 0.9).alias("seen"), *(F.first(n, ignorenulls=True).alias(n) for n in ("stated", "area", "words")))
    got = got.withColumn("canopy", F.coalesce(c("seen"), c("ground") + c("stated"))).withColumn("height", F.coalesce(c("stated"), F.when(c("canopy") > c("ground"), c("canopy") - c("ground")).when(c("canopy") <= c("ground"), 0.0)))
    said, small = F.lower(F.coalesce("words", F.lit(""))), F.coalesce(c("area") <= 180, F.lit(False))
    kind = F.when(said.contains("wood"), "woodland").when((said.contains("tree") & small) | (small & (F.coalesce("height", F.lit(0.0)) >= 3)), "individual-tree").otherwise("canopy-group")
    status = F.when(c("ground").isNotNull() & c("canopy").isNotNull() & c("height").isNotNull(), "resolved").when(F.coalesce("ground", "canopy", "area").isNotNull(), "partial").otherwise("unresolved")
    return got.select(
        *key, status.alias("status"), kind.alias("class"), half_up(c("ground"), 3).alias("ground"), half_up(c("canopy"), 3).alias("canopy"), half_up(c("height"), 3).alias("height"),
        half_up(2 * F.sqrt(F.when(c("area") > 0, c("area")) / math.pi), 3).alias("diameter"), half_up(c("area") * c("height") * 0.55, 3).alias("volume"),
    )


def species_shares(evidence: DataFrame, key: str) -> DataFrame:
    """Shares of species at each key with their places, and the trust in the first: key, species, weight. Weights of 0 or less do not count."""
    summed = evidence.filter((F.col("weight") > 0) & (F.coalesce("species", F.lit("")) != "")).groupBy(key, "species").agg(F.sum("weight").alias("weight"))
    by = Window.partitionBy(key)  # a row for each species
    shared = summed.withColumns({"share": F.col("weight") / F.sum("weight").over(by), "n": F.count("*").over(by), "place": F.row_number().over(by.orderBy(F.desc("weight"), "species"))})
    trust = F.least(F.lit(0.93), 0.52 + F.col("share") * 0.28 + F.least(F.lit(1.0), F.col("n") / 4) * 0.12)
    return shared.select(key, "species", "place", half_up(F.col("share"), 6).alias("share"), F.when(F.col("place") == 1, half_up(trust, 3)).alias("trust"))


def ride_summary(samples: DataFrame) -> DataFrame:
    """Coverage, trust, height range, methods and newest date of each ride: samples with ride (name), id, elevation, trust, method and date."""
    seen = F.col("elevation").isNotNull()
    got = samples.groupBy(F.coalesce(F.nullif("ride", F.lit("")), "id").alias("ride")).agg(
        F.count("*").alias("samples"), F.count("elevation").alias("seen"), (F.sum(F.when(seen, F.coalesce("trust", F.lit(0.0))).otherwise(0.0)) / F.nullif(F.count("elevation"), F.lit(0))).alias("trust"),
        F.min("elevation").alias("low"), F.max("elevation").alias("high"), F.sort_array(F.collect_set("method")).alias("methods"), F.max("date").alias("newest"),
    )
    share = F.col("seen") / F.col("samples")
    return got.select("ride", "samples", half_up(share, 3).alias("coverage"), half_up(F.coalesce("trust", F.lit(0.0)), 3).alias("trust"), "low", "high", F.array_join("methods", ",").alias("methods"), "newest", F.when(share >= 0.999, "full").when(share > 0, "partial").otherwise("plan-only").alias("status"))


def chunk_bounds(operations: DataFrame, by: list[str], margin: int) -> DataFrame:
    """Chunks (16 blocks) that operations and their margin reach, the number of them, and the range of heights with 0 in it: x0, x1, y0, y1, z0, z1."""
    edge = lambda f, c, m: F.floor((f(c) + m) / 16).cast("long")
    got = operations.groupBy(*by).agg(
        edge(F.min, "x0", -margin).alias("min_cx"), edge(F.max, "x1", margin).alias("max_cx"), edge(F.min, "z0", -margin).alias("min_cz"), edge(F.max, "z1", margin).alias("max_cz"),
        F.least(F.lit(0), F.min("y0"), F.min("y1")).alias("low"), F.greatest(F.lit(0), F.max("y0"), F.max("y1")).alias("high"),
    )
    return got.withColumn("chunks", (F.col("max_cx") - F.col("min_cx") + 1) * (F.col("max_cz") - F.col("min_cz") + 1))
