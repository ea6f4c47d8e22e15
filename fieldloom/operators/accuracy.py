"""Accuracy of a reconstruction: evidence gaps, grades, topology and semantics summaries, capabilities, and the strict gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.numbers import clamp, half_up, number_or_null

#: Gap codes after which a model is no exact one.
NOT_EXACT = (
    "BOUNDARY_UNVERIFIED", "RIDE_VERTICAL_GEOMETRY_ABSENT", "RIDE_VERTICAL_GEOMETRY_PARTIAL", "RIDE_ATTACHMENTS_WITHHELD", "RIDE_PLAN_PROFILE_MISALIGNED", "BRIDGE_VERTICAL_GEOMETRY_PARTIAL", "TERRAIN_NOT_SURVEY_GRADE", "TERRAIN_FLAT_DATUM",
)
#: Weights of the components, and the least scores of the grades.
WEIGHTS = {"boundary": 0.18, "planimetry": 0.24, "rides": 0.22, "structures": 0.16, "terrain": 0.14, "freshness": 0.06}
GRADES = (("A", 0.9), ("B", 0.8), ("C", 0.65), ("D", 0.5))
FULL = 0.999


def _grade(score: Column) -> Column:
    out = F.lit("E")
    for name, least in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def with_gaps(facts: DataFrame) -> DataFrame:
    """Adds gaps (array of severity:code, in order of the questions), exact and critical to rows of facts.

    facts: boundary_verified, tracks, ride_coverage, interpolated, inferred, tunnel_gaps, terrain_mode, attachments, attachments_resolved, misaligned, buildings, buildings_high,
    conflicts, provider, resolution, terrain_coverage, paths, width, material, colour, pattern, components, candidates, compiled, photo_status, photo_eligible, photo_coverage,
    discovery, recovery_status, permitted, steep, bridge_review, bridges, bridges_high, trees, trees_high, unknown_materials, dated. Missing counts and coverages are 0.
    """
    n = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    provider, mode = F.coalesce(F.col("provider"), F.lit("none")), F.coalesce(F.col("terrain_mode"), F.lit("inferred"))
    cover = clamp(F.coalesce(F.col("terrain_coverage"), F.lit(1.0)), 0.0, 1.0)
    walked, photo = n("paths") > 0, F.coalesce(F.col("photo_status") == "available", F.lit(False))
    seeking = walked & (F.coalesce(F.col("discovery"), F.lit("off")) != "off")
    recovered = F.coalesce(F.col("recovery_status") == "available", F.lit(False))
    rules = [
        ("critical", "BOUNDARY_UNVERIFIED", ~yes("boundary_verified")),
        ("high", "RIDE_TRACKS_ABSENT", n("tracks") == 0),
        ("high", "RIDE_VERTICAL_GEOMETRY_ABSENT", (n("tracks") > 0) & (n("ride_coverage") <= 0)),
        ("high", "RIDE_VERTICAL_GEOMETRY_PARTIAL", (n("tracks") > 0) & (n("ride_coverage") > 0) & (n("ride_coverage") < FULL)),
        ("medium", "RIDE_PROFILE_INTERPOLATED", n("interpolated") > 0),
        ("high", "RIDE_PROFILE_INFERRED", n("inferred") > 0),
        ("high", "RIDE_TUNNEL_HEIGHT_INFERRED", (n("tunnel_gaps") > 0) & (mode == "inferred")),
        ("critical", "RIDE_TUNNEL_VERTICAL_PARTIAL", (n("tunnel_gaps") > 0) & (mode == "evidence")),
        ("high", "RIDE_ATTACHMENTS_WITHHELD", n("attachments_resolved") < n("attachments")),
        ("critical", "RIDE_PLAN_PROFILE_MISALIGNED", n("misaligned") > 0),
        ("high", "BUILDING_HEIGHTS_PARTIAL", n("buildings_high") < n("buildings")),
        ("medium", "BUILDING_HEIGHT_CONFLICTS", n("conflicts") > 0),
        ("high", "TERRAIN_FLAT_DATUM", provider == "none"),
        ("high", "TERRAIN_NOT_SURVEY_GRADE", (provider != "none") & (n("resolution") > 10)),
        ("high", "TERRAIN_COVERAGE_PARTIAL", (provider != "none") & (cover < 0.99)),
        ("high", "PATH_NETWORK_ABSENT", ~walked),
        ("medium", "PATH_WIDTHS_PARTIAL", walked & (n("width") < FULL)),
        ("high", "PATH_MATERIALS_PARTIAL", walked & (n("material") < FULL)),
        ("high", "PATH_COLOURS_PARTIAL", walked & (n("colour") < FULL)),
        ("medium", "PATH_PATTERNS_PARTIAL", walked & (n("pattern") < FULL)),
        ("high", "PATH_TOPOLOGY_FRAGMENTED", walked & (n("components") > 3)),
        ("medium", "PATH_TOPOLOGY_FRAGMENTED", walked & n("components").between(2, 3)),
        ("medium", "PATH_SOURCE_REPAIR_REVIEW", walked & (n("candidates") > n("compiled"))),
        ("high", "PATH_COMPLETENESS_SOURCE_LIMITED", walked),
        ("high", "ORTHOPHOTO_PATH_EVIDENCE_UNAVAILABLE", walked & ~photo),
        ("high", "ORTHOPHOTO_PATH_EVIDENCE_QA_ONLY", walked & photo & (n("photo_eligible") == 0)),
        ("medium", "ORTHOPHOTO_PATH_EVIDENCE_PARTIAL", walked & photo & (n("photo_eligible") > 0) & (n("photo_coverage") < 0.8)),
        ("medium", "PATH_TOPOLOGY_RECOVERY_EMPTY", seeking & ~recovered),
        ("high", "PATH_TOPOLOGY_RECOVERY_QA_ONLY", seeking & recovered & ~yes("permitted")),
        ("high", "PATH_TERRAIN_STEEP_REVIEW", seeking & (n("steep") > 0)),
        ("critical", "PATH_BRIDGE_STRUCTURE_REVIEW", seeking & (n("bridge_review") > 0)),
        ("high", "BRIDGE_VERTICAL_GEOMETRY_PARTIAL", n("bridges_high") < n("bridges")),
        ("high", "TREE_DATA_ABSENT", n("trees") == 0),
        ("medium", "TREE_HEIGHTS_PARTIAL", (n("trees") > 0) & (n("trees_high") < n("trees"))),
        ("medium", "BUILDING_MATERIALS_PARTIAL", n("unknown_materials") > 0),
        ("medium", "FRESHNESS_UNKNOWN", n("dated") == 0),
    ]
    gaps = F.array_compact(F.array(*(F.when(rule, f"{severity}:{code}") for severity, code, rule in rules)))
    out = facts.withColumn("gaps", gaps)
    return out.withColumns({"critical": F.size(F.filter("gaps", lambda g: g.startswith("critical"))), "exact": ~F.exists("gaps", lambda g: F.split_part(g, F.lit(":"), F.lit(2)).isin(*NOT_EXACT))})


def with_score(rows: DataFrame) -> DataFrame:
    """Adds score, its grade, and the grade held at B where a critical gap is left, from columns named as WEIGHTS and critical."""
    score = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    rows = rows.withColumn("_score", score).withColumn("score_grade", _grade(F.col("_score")))
    held = F.when((F.col("critical") > 0) & (F.col("score_grade") == "A"), "B").otherwise(F.col("score_grade"))
    return rows.withColumns({"score": half_up(F.col("_score"), 3), "grade": held}).drop("_score")


def gate(rows: DataFrame, least: float = 0.75) -> DataFrame:
    """The rows, or an error where one has a critical gap or a score below `least`."""
    bad = (F.col("critical") > 0) | (F.col("score") < least)
    return rows.withColumn("score", F.when(bad, F.raise_error(F.format_string("strict evidence gate failed: score %s, %s critical gaps", F.col("score"), F.col("critical")))).otherwise(F.col("score")))


def topology(features: DataFrame, by: list[str]) -> DataFrame:
    """Relations, polygons, their parts and holes, from element (type), geometry (type) and rings (rings of each polygon)."""
    area = F.col("geometry").isin("Polygon", "MultiPolygon") & (F.size("rings") > 0)
    holes = F.aggregate("rings", F.lit(0), lambda n, k: n + F.greatest(k - 1, F.lit(0)))
    some = lambda c: F.coalesce(F.sum(F.when(area, c)), F.lit(0)).cast("long")
    return features.groupBy(*by).agg(F.count_if(F.col("element") == "relation").alias("relations"), F.count_if(area).alias("polygons"), some(F.size("rings")).alias("parts"), some(holes).alias("holes"), F.count_if(area & (F.size("rings") > 1)).alias("disjoint"))


def semantics(features: DataFrame, by: list[str], tags: str = "tags") -> DataFrame:
    """Counts of explicit bridges, tunnels, layers and entrances."""
    get = lambda k: F.nullif(F.col(tags)[k], F.lit(""))
    layer = number_or_null(F.col(tags)["layer"])
    counts = {
        "bridges": get("bridge") != "no", "tunnels": get("tunnel") != "no", "layered": layer.isNotNull(), "above": layer > 0, "below": layer < 0, "entrances": F.coalesce(get("entrance"), get("door")).isNotNull(), "main_entrances": get("entrance") == "main",
    }
    return features.groupBy(*by).agg(*(F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in counts.items()))


def tree_summary(trees: DataFrame, by: list[str]) -> DataFrame:
    """Counts of mapped trees by geometry, class and evidence: geometry, model, position, height, crown, species, competitors, rejected."""
    c = F.col
    counts = {
        "points": c("geometry") == "Point", "rows": c("model") == "tree-row", "woodland": c("model") == "woodland", "shrubs": c("model") == "shrubland", "hedges": c("model") == "hedge", "orchards": c("model") == "orchard",
        "derived": c("position").startswith("density-derived"), "high": c("height").isNotNull(), "crowned": c("crown").isNotNull(), "separated": (c("competitors") > 0) & (c("rejected") > 0), "known": F.coalesce(c("species"), F.lit("")) != "",
    }
    return trees.groupBy(*by).agg(F.count("*").alias("mapped"), *(F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in counts.items()))


def capability(coverage: Column, mapped: Column) -> Column:
    """available, partial, missing or not-applicable, by what is mapped and how much of it is covered."""
    return F.when(F.coalesce(mapped, F.lit(0)) == 0, "not-applicable").when(coverage >= 1, "available").when(coverage > 0, "partial").otherwise("missing")


def capabilities(rows: DataFrame, id: str, measures: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each measure of each input row: name, status and coverage; measures: name to (covered, mapped) columns."""
    listed = F.array(*(F.struct(F.lit(n).alias("name"), F.when(F.col(m) > 0, half_up(F.col(c) / F.col(m), 3)).otherwise(0.0).alias("coverage"), F.col(m).cast("long").alias("mapped")) for n, (c, m) in measures.items()))
    got = rows.select(id, F.explode(listed).alias("m"))
    return got.select(id, "m.name", "m.coverage", capability(F.col("m.coverage"), F.col("m.mapped")).alias("status"))
