"""Acquired sources: ranking, alignment, caches, provenance, inheritance, fusion counts, compact seeds, and surface shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Laying patterns, those that stand for another, the pattern and its scale that a material has by default.
PATTERNS = ("herringbone", "basketweave", "running_bond", "stack_bond", "checker", "grid", "stripes", "random", "mixed", "solid", "slabs", "mosaic", "speckled", "organic")
SAME_PATTERN = {"basketweave": "grid", "stack_bond": "grid", "random": "mixed"}
DEFAULT_PATTERN = {"paving_stones": "slabs", "brick": "running_bond", "sett": "mosaic", "cobblestone": "mosaic", "gravel": "speckled", "fine_gravel": "speckled", "compacted": "speckled", "earth": "organic", "dirt": "organic", "grass": "organic", "wood": "stripes", "boardwalk": "stripes"}
WIDE_PATTERN = ("paving_stones", "gravel", "fine_gravel", "earth", "dirt", "grass")
#: Shapes of blocks, directions by name, words of a block's family in order, families that walls and fences have.
SHAPES = ("slab", "stairs", "wall", "fence", "trapdoor")
DIRECTIONS = {"south": 0, "west": 1, "north": 2, "east": 3}
FAMILIES = (("sandstone", "sandstone"), ("brick|red_terracotta", "brick"), ("spruce", "spruce"), ("dark_oak", "dark_oak"), ("birch", "birch"), ("oak|plank", "oak"))
WALLS, WOODS = ("sandstone", "brick", "stone_brick"), ("spruce", "dark_oak", "birch", "oak")


def ranked_places(places: DataFrame, by: str, query: Column, most: int = 5) -> DataFrame:
    """The best places of each search: importance, ten points for theme parks, two where the name begins with what was asked; ties by name."""
    score = F.coalesce("importance", F.lit(0.0)) + F.when(F.col("type") == "theme_park", 10).otherwise(0) + F.when(F.lower("name").startswith(F.lower(query)), 2).otherwise(0)
    return places.withColumn("score", score).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "name"))).filter(F.col("place") <= most)


def alignment(terrain: DataFrame, surface: DataFrame, id: str) -> DataFrame:
    """Whether two rasters of an id lie on one grid: width, height, min_x, min_y, max_x, max_y, resolution."""
    near = lambda c: F.abs(F.col(f"t.{c}") - F.col(f"s.{c}")) < 0.001
    fits = (F.col("t.width") == F.col("s.width")) & (F.col("t.height") == F.col("s.height"))
    for c in ("min_x", "min_y", "max_x", "max_y", "resolution"):
        fits = fits & near(c)
    return terrain.alias("t").join(surface.alias("s"), F.col(f"t.{id}") == F.col(f"s.{id}")).select(F.col(f"t.{id}").alias(id), F.coalesce(fits, F.lit(False)).alias("aligned"))


def cache_key(*parts: Column) -> Column:
    """The name of a cached answer: SHA-256 of the request's parts."""
    return F.sha2(F.concat_ws("\n", *parts), 256)


def to_fetch(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests without a cached answer; each key once, by the first of its requests."""
    return requests.join(cache.select(key), key, "left_anti")


def seeded(documents: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Documents with their own content, else that of the shared corpus; origin tells which."""
    met = documents.alias("d").join(corpus.select(key, F.col("content").alias("_shared")).alias("c"), key, "left")
    origin = F.when(F.col("content").isNotNull(), "own").when(F.col("_shared").isNotNull(), "corpus").otherwise("missing")
    return met.select(key, F.coalesce("content", "_shared").alias("content"), origin.alias("origin"))


def covering(tiles: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Tiles that meet a box, borders included."""
    meets = (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    return tiles.filter(meets)


def provenance(clouds: DataFrame, tiles: DataFrame) -> DataFrame:
    """Point clouds with the survey tile of the same file name, the first where there are several."""
    name = lambda c: F.lower(F.regexp_extract(c, r"([^/\\]+)$", 1))
    first = tiles.groupBy(name("file").alias("_file")).agg(F.min_by(F.struct("tile", "flown"), "seq").alias("_t"))
    return clouds.withColumn("_file", name("file")).join(first, "_file", "left").select(*clouds.columns, F.col("_t.tile").alias("tile"), F.col("_t.flown").alias("flown"))


def inherited_tags(own: DataFrame, replaced: DataFrame, id: str) -> DataFrame:
    """Tags of each row, with those of the rows that it replaces (id, tags) where these agree and it has none of its own."""
    pairs = replaced.select(id, F.explode("tags").alias("k", "v")).groupBy(id, "k").agg(F.min("v").alias("v"), F.max("v").alias("w")).filter("v = w")
    known = pairs.groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_known"))
    more = F.map_filter("_known", lambda k, v: ~F.map_contains_key("tags", k))
    return own.join(known, id, "left").withColumn("tags", F.when(F.col("_known").isNull(), F.col("tags")).otherwise(F.map_concat("tags", more))).drop("_known")


def fusion_counts(decisions: DataFrame, bucket: str) -> DataFrame:
    """Considered, accepted, duplicate, partial and replaced features of each source, and whether it is of use."""
    n = lambda d: F.count_if(F.col("decision") == d)
    got = decisions.groupBy(bucket).agg(F.count("*").alias("considered"), *(n(d).alias(d) for d in ("accepted", "duplicate", "partial", "replaced")))
    return got.withColumn("status", F.when(F.col("accepted") + F.col("replaced") > 0, "active").otherwise("nothing-new"))


def compact_lines(features: DataFrame, allowed: DataFrame, document: str) -> DataFrame:
    """Features of allowed documents, once for each document, kind and geometry, as numbers: document and kind by dictionaries, points in centimetres from the one before.

    The dictionaries have a row for each document and kind, not for each feature.
    """
    kept = features.join(allowed.select(document).distinct(), document, "left_semi").dropDuplicates([document, "kind", "line"])
    number = lambda c: kept.select(c).distinct().withColumn(f"{c}_no", F.row_number().over(Window.orderBy(c)) - 1)
    cm = lambda c: F.floor(c * 100 + 0.5).cast("long")
    step = lambda axis: F.transform("line", lambda p, i: cm(p[axis]) - F.when(i > 0, cm(F.get("line", i - 1)[axis])).otherwise(0))
    return kept.join(number(document), document).join(number("kind"), "kind").select(f"{document}_no", "kind_no", step("x").alias("dx"), step("z").alias("dz"))


def pattern(said: Column, material: Column) -> Column:
    """struct<pattern, scale>: a stated laying pattern by its usual name, else the material's."""
    key = F.regexp_replace(F.lower(F.trim(said)), "[ -]+", "_")
    named, usual = F.when(key.isin(*PATTERNS), key), F.lit("solid")
    for name, other in SAME_PATTERN.items():
        named = F.when(key == name, other).otherwise(named)
    for name, other in DEFAULT_PATTERN.items():
        usual = F.when(material == name, other).otherwise(usual)
    return F.struct(F.coalesce(named, usual).alias("pattern"), F.when(material.isin(*WIDE_PATTERN), 2).otherwise(1).alias("scale"))


def quarter_turn(text: Column) -> Column:
    """The first number of a text as a turn in degrees, rounded to quarters; 0 without one."""
    turn = F.regexp_extract(text.cast("string"), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return F.coalesce(F.pmod(F.floor(turn / 90 + 0.5) * 90, F.lit(360)), F.lit(0)).cast("int")


def shaped_block(block: Column, shape: Column, direction: Column) -> Column:
    """The block in a stated shape, of the family that its name tells; the block itself without a known shape."""
    form = F.regexp_replace(F.lower(F.trim(shape)), "[ _]+", "-")
    said = F.lower(F.trim(direction.cast("string")))
    turn = F.when(said.rlike("^[0-3]$"), said.try_cast("int")).otherwise(0)
    for name, number in DIRECTIONS.items():
        turn = F.when(said == name, number).otherwise(turn)
    turn = F.coalesce(turn, F.lit(0)).cast("string")
    family = F.lit("stone_brick")
    for words, name in reversed(FAMILIES):
        family = F.when(F.lower(block).rlike(words), name).otherwise(family)
    wood, wall = F.when(family.isin(*WOODS), family).otherwise("oak"), F.when(family.isin(*WALLS), family).otherwise("cobblestone")
    spec = lambda *parts: F.concat(F.lit("minecraft:"), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return (
        F.when(form == "slab", spec(family, "_slab[minecraft:vertical_half=bottom]")).when(form == "stairs", spec(family, "_stairs[upside_down_bit=false,weirdo_direction=", turn, "]"))
        .when(form == "wall", spec(wall, "_wall")).when(form == "fence", spec(wood, "_fence")).when(form == "trapdoor", spec(wood, "_trapdoor[direction=", turn, ",open_bit=false,upside_down_bit=false]")).otherwise(block)
    )
