"""Queries over accuracy, gaps and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import accuracy
from fieldloom.plans.made import Made
from fieldloom.plans.tables import read

FACTS = Made(
    "p_partkey",
    {
        "boundary_verified": [True, False, None, True], "tracks": [3, 0, 5], "ride_coverage": [0.0, 0.5, 1.0, 0.9995, None], "interpolated": [0, 4, None], "inferred": [0, 0, 2], "tunnel_gaps": [0, 3], "terrain_mode": [None, "evidence", "inferred", "off"], "attachments": [2, 0, 5], "attachments_resolved": [2, 0, None], "misaligned": [0, 0, 0, 1],
        "buildings": [10, 0, 4], "buildings_high": [10, 4, 0], "conflicts": [0, 1, 0], "provider": ["lidar", "none", "grid", None], "resolution": [1.0, 30.0, None, 10.0], "terrain_coverage": [1.0, 0.5, None, 0.995], "paths": [8, 0, 3, 2], "width": [1.0, 0.4, None], "material": [0.0, 1.0], "colour": [1.0, 0.2, 0.9999], "pattern": [None, 1.0],
        "components": [1, 2, 3, 4, 9], "candidates": [3, 0, 1], "compiled": [3, 0], "photo_status": ["available", None, "available", "failed"], "photo_eligible": [0, 4, 2], "photo_coverage": [0.9, 0.1, None], "discovery": ["off", "assist", None], "recovery_status": ["available", None], "permitted": [True, None], "steep": [0, 2], "bridge_review": [0, 0, 1],
        "bridges": [2, 0, 1], "bridges_high": [1, 0], "trees": [5, 0], "trees_high": [5, 1, 0], "unknown_materials": [0, 3], "dated": [0, 7],
        "boundary": [1.0, 0.75, 0.25], "planimetry": [0.9, 0.95, 0.4], "rides": [1.0, 0.5, 0.0], "structures": [0.9, 1.0, 0.5], "terrain": [0.95, 0.75, 0.1], "freshness": [1.0, 0.75, 0.2],
    },
)
SHAPES = Made("p_partkey", {"element": ["way", "relation", "node", None], "geometry": ["Polygon", "MultiPolygon", "Point", "LineString", None], "first": [1, 2, 4], "second": [None, 1, 3]})
SAID = Made("p_partkey", {"bridge": [None, "yes", "no", "", "viaduct"], "tunnel": [None, "no", "culvert"], "layer": ["1", None, "-2", "x", "0", ""], "entrance": [None, None, "main", "yes"], "door": [None, "hinged"]})
TREES = Made(
    "p_partkey",
    {
        "geometry": ["Point", "Polygon", None], "model": ["tree-row", "woodland", None, "shrubland", "hedge", "orchard", "single"], "position": ["mapped", "density-derived-grid", None], "height": [None, 5.0], "crown": [3.0, None, None], "species": [None, "oak", ""], "competitors": [0, 2, None], "rejected": [1, 0, 3, None],
    },
)
MEASURES = {"widths": ("p_size", "p_partkey"), "ones": ("p_size", "p_size"), "none": ("zero", "p_size"), "absent": ("p_size", "zero")}


def evidence_gaps(spark: SparkSession, d: str) -> DataFrame:
    got = accuracy.with_score(accuracy.with_gaps(read(spark, d, "part").select("p_partkey", *FACTS.columns())))
    return got.select("p_partkey", F.array_join("gaps", ",").alias("gaps"), F.col("critical").cast("long").alias("critical"), "exact", "score", "score_grade", "grade")


def topology_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_brand", *SHAPES.columns())
    rings = F.array_compact(F.array(F.col("first"), F.when(F.col("geometry") == "MultiPolygon", F.col("second")))).cast("array<int>")
    return accuracy.topology(rows.withColumn("rings", F.when(F.col("geometry").isin("Polygon", "MultiPolygon"), rings).otherwise(F.array().cast("array<int>"))), ["p_brand"])


def semantics_summary(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.semantics(read(spark, d, "part").select("p_brand", SAID.tags().alias("tags")), ["p_brand"])


def tree_evidence(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.tree_summary(read(spark, d, "part").select("p_brand", *TREES.columns()), ["p_brand"])


def source_capabilities(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.capabilities(read(spark, d, "part").select("p_partkey", "p_size", F.lit(0).alias("zero")), "p_partkey", MEASURES)


QUERIES = {f.__name__: f for f in (evidence_gaps, topology_summary, semantics_summary, tree_evidence, source_capabilities)}

_RULES = [
    ("NOT coalesce(boundary_verified, false)", "critical:BOUNDARY_UNVERIFIED"), ("tracks = 0", "high:RIDE_TRACKS_ABSENT"), ("tracks > 0 AND coalesce(ride_coverage, 0) = 0", "high:RIDE_VERTICAL_GEOMETRY_ABSENT"), ("tracks > 0 AND ride_coverage = 0.5", "high:RIDE_VERTICAL_GEOMETRY_PARTIAL"),
    ("interpolated = 4", "medium:RIDE_PROFILE_INTERPOLATED"), ("inferred = 2", "high:RIDE_PROFILE_INFERRED"), ("tunnel_gaps = 3 AND coalesce(terrain_mode, 'inferred') = 'inferred'", "high:RIDE_TUNNEL_HEIGHT_INFERRED"), ("tunnel_gaps = 3 AND terrain_mode = 'evidence'", "critical:RIDE_TUNNEL_VERTICAL_PARTIAL"),
    ("coalesce(attachments_resolved, 0) < attachments", "high:RIDE_ATTACHMENTS_WITHHELD"), ("misaligned = 1", "critical:RIDE_PLAN_PROFILE_MISALIGNED"), ("buildings_high < buildings", "high:BUILDING_HEIGHTS_PARTIAL"), ("conflicts = 1", "medium:BUILDING_HEIGHT_CONFLICTS"),
    ("coalesce(provider, 'none') = 'none'", "high:TERRAIN_FLAT_DATUM"), ("provider <> 'none' AND resolution = 30", "high:TERRAIN_NOT_SURVEY_GRADE"), ("provider <> 'none' AND terrain_coverage = 0.5", "high:TERRAIN_COVERAGE_PARTIAL"), ("paths = 0", "high:PATH_NETWORK_ABSENT"),
    ("paths > 0 AND coalesce(width, 0) < 1", "medium:PATH_WIDTHS_PARTIAL"), ("paths > 0 AND material = 0", "high:PATH_MATERIALS_PARTIAL"), ("paths > 0 AND colour = 0.2::DOUBLE", "high:PATH_COLOURS_PARTIAL"), ("paths > 0 AND pattern IS NULL", "medium:PATH_PATTERNS_PARTIAL"), ("paths > 0 AND components > 3", "high:PATH_TOPOLOGY_FRAGMENTED"),
    ("paths > 0 AND components IN (2, 3)", "medium:PATH_TOPOLOGY_FRAGMENTED"), ("paths > 0 AND candidates > compiled", "medium:PATH_SOURCE_REPAIR_REVIEW"), ("paths > 0", "high:PATH_COMPLETENESS_SOURCE_LIMITED"), ("paths > 0 AND coalesce(photo_status, '') <> 'available'", "high:ORTHOPHOTO_PATH_EVIDENCE_UNAVAILABLE"),
    ("paths > 0 AND photo_status = 'available' AND photo_eligible = 0", "high:ORTHOPHOTO_PATH_EVIDENCE_QA_ONLY"), ("paths > 0 AND photo_status = 'available' AND photo_eligible > 0 AND coalesce(photo_coverage, 0) < 0.8", "medium:ORTHOPHOTO_PATH_EVIDENCE_PARTIAL"),
    ("paths > 0 AND discovery = 'assist' AND recovery_status IS NULL", "medium:PATH_TOPOLOGY_RECOVERY_EMPTY"), ("paths > 0 AND discovery = 'assist' AND recovery_status = 'available' AND permitted IS NULL", "high:PATH_TOPOLOGY_RECOVERY_QA_ONLY"), ("paths > 0 AND discovery = 'assist' AND steep = 2", "high:PATH_TERRAIN_STEEP_REVIEW"),
    ("paths > 0 AND discovery = 'assist' AND bridge_review = 1", "critical:PATH_BRIDGE_STRUCTURE_REVIEW"), ("bridges_high < bridges", "high:BRIDGE_VERTICAL_GEOMETRY_PARTIAL"), ("trees = 0", "high:TREE_DATA_ABSENT"), ("trees > 0 AND trees_high < trees", "medium:TREE_HEIGHTS_PARTIAL"), ("unknown_materials = 3", "medium:BUILDING_MATERIALS_PARTIAL"), ("dated = 0", "medium:FRESHNESS_UNKNOWN"),
]
ORACLE_SQL = {
    "evidence_gaps": f"""
WITH f AS (SELECT p_partkey, {FACTS.sql()} FROM part), g AS (SELECT *, [x FOR x IN [{', '.join(f"CASE WHEN {rule} THEN '{code}' END" for rule, code in _RULES)}] IF x IS NOT NULL] AS gaps, 0.18::DOUBLE * boundary + 0.24::DOUBLE * planimetry + 0.22::DOUBLE * rides + 0.16::DOUBLE * structures + 0.14::DOUBLE * terrain + 0.06::DOUBLE * freshness AS raw FROM f),
s AS (SELECT *, CAST(len([x FOR x IN gaps IF starts_with(x, 'critical')]) AS BIGINT) AS critical, CASE WHEN raw >= 0.9 THEN 'A' WHEN raw >= 0.8 THEN 'B' WHEN raw >= 0.65 THEN 'C' WHEN raw >= 0.5 THEN 'D' ELSE 'E' END AS score_grade FROM g)
SELECT p_partkey, array_to_string(gaps, ',') AS gaps, critical, len([x FOR x IN gaps IF string_split(x, ':')[2] IN ({', '.join(f"'{x}'" for x in accuracy.NOT_EXACT)})]) = 0 AS exact, floor(raw * 1000 + 0.5) / 1000 AS score, score_grade, CASE WHEN critical > 0 AND score_grade = 'A' THEN 'B' ELSE score_grade END AS grade FROM s""",
    "topology_summary": f"""
WITH s AS (SELECT p_brand, {SHAPES.sql()} FROM part), k AS (SELECT *, coalesce(geometry IN ('Polygon', 'MultiPolygon'), false) AS area, CASE WHEN geometry = 'MultiPolygon' THEN second END AS more FROM s)
SELECT p_brand, count_if(element = 'relation') AS relations, count_if(area) AS polygons, CAST(coalesce(sum(CASE WHEN area THEN 1 + (more IS NOT NULL)::INT END), 0) AS BIGINT) AS parts, CAST(coalesce(sum(CASE WHEN area THEN first - 1 + coalesce(more - 1, 0) END), 0) AS BIGINT) AS holes, count_if(area AND more IS NOT NULL) AS disjoint FROM k GROUP BY 1""",
    "semantics_summary": f"""
SELECT p_brand, count_if(bridge IN ('yes', 'viaduct')) AS bridges, count_if(tunnel = 'culvert') AS tunnels, count_if(layer IN ('1', '-2', '0')) AS layered, count_if(layer = '1') AS above, count_if(layer = '-2') AS below, count_if(entrance IS NOT NULL OR door IS NOT NULL) AS entrances, count_if(entrance = 'main') AS main_entrances
FROM (SELECT p_brand, {SAID.sql()} FROM part) GROUP BY 1""",
    "tree_evidence": f"""
SELECT p_brand, count(*) AS mapped, count_if(geometry = 'Point') AS points, count_if(model = 'tree-row') AS rows, count_if(model = 'woodland') AS woodland, count_if(model = 'shrubland') AS shrubs, count_if(model = 'hedge') AS hedges, count_if(model = 'orchard') AS orchards, count_if(position = 'density-derived-grid') AS derived,
 count_if(height IS NOT NULL) AS high, count_if(crown IS NOT NULL) AS crowned, count_if(competitors > 0 AND rejected > 0) AS separated, count_if(species = 'oak') AS known FROM (SELECT p_brand, {TREES.sql()} FROM part) GROUP BY 1""",
    "source_capabilities": """
SELECT p_partkey, name, coverage, CASE WHEN name = 'absent' OR (name = 'widths' AND p_partkey = 0) THEN 'not-applicable' WHEN coverage >= 1 THEN 'available' WHEN coverage > 0 THEN 'partial' ELSE 'missing' END AS status
FROM (SELECT p_partkey, unnest(['widths', 'ones', 'none', 'absent']) AS name, unnest([CASE WHEN p_partkey > 0 THEN floor(p_size / nullif(p_partkey, 0)::DOUBLE * 1000 + 0.5) / 1000 ELSE 0 END, 1, 0, 0]) AS coverage FROM part)""",
}
