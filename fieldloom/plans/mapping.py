"""Queries over tag cascades, typed relations and sampled heights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import kinds
from fieldloom.operators import relations
from fieldloom.plans.made import Made
from fieldloom.plans.tables import points, read

TYPES = ("ride-support", "ride-track", "building", "path", "barrier", "bridge", "water")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.pmod(F.col("vec_id"), F.lit(7)) + 1).cast("int"))
    return points(spark, d).select(
        F.col("vec_id").alias("id"), kind.alias("type"), F.col("x").cast("double").alias("min_x"), (F.col("x") + 6.0).alias("max_x"), F.col("z").cast("double").alias("min_z"), (F.col("z") + 4.0).alias("max_z"),
        F.when(F.col("vec_id") % 5 != 0, F.col("kind") / 2).alias("base"), F.when(F.col("vec_id") % 3 != 0, 0.5).alias("confidence"),
    )


def typed_relations(spark: SparkSession, d: str) -> DataFrame:
    return relations.inferred(_nodes(spark, d)).withColumn("distance_m", F.floor(F.col("distance_m") * 1000 + 0.5) / 1000)


def surface_heights(spark: SparkSession, d: str) -> DataFrame:
    samples = read(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 1000).alias("surface"), F.col("l_quantity").alias("terrain"))
    return relations.building_heights(samples, "l_suppkey", "surface", "terrain")


def height_candidates(spark: SparkSession, d: str) -> DataFrame:
    pts = read(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 2000).alias("elevation"), (F.col("l_quantity") / 10).alias("ground"), F.pmod(F.col("l_partkey"), F.lit(7)).alias("class"))
    return relations.height_candidates(pts, ["l_suppkey"], "elevation", "ground").select("l_suppkey", "bin", "n", "height", "quality", "place")


_no = [None] * 5
TAGS = Made(
    "p_partkey",
    {
        "tourism": ["theme_park", *_no, "attraction", "", *_no], "roller_coaster": [*_no, "track", None, "support", "station", *_no], "roller_coaster:track": [None, "steel"], "man_made": [*_no, "ride_attachment", None, "tower", ""],
        "ride_attachment": [*_no, *_no, "catwalk", *_no], "building": [*_no, None, "", "yes", *_no], "attraction": [*_no, *_no, "carousel"], "barrier": [*_no, "hedge", "fence"], "natural": [*_no, "tree", "scrub", None, "cliff", "water", "beach"],
        "landuse": [*_no, "orchard", "grass"], "landcover": [*_no, *_no, "shrubs", "mud"], "geological": [*_no, *_no, "outcrop", "x"], "area:highway": [*_no, *_no, "Footway", "bridleway", "traffic_island"], "highway": [*_no, "bridleway", "track", None, "crossing", "steps"],
        "water": [*_no, *_no, "pond"], "waterway": [*_no, *_no, "stream", None], "leisure": [*_no, *_no, "swimming_pool", "park"], "railway": [*_no, *_no, "rail"], "amenity": [*_no, "toilets", *_no], "shop": [*_no, "gift", None], "entrance": [*_no, "main"], "door": [None, None, "hinged"],
        "historic": [None, None, None, "ruins"], "information": [*_no, "board"], "playground": [*_no, "slide"], "public_transport": [None, "platform"], "area": [None, "yes", "no", None], "foot": [*_no, "private"],
    },
)


def tag_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_partkey", "p_size", TAGS.tags().alias("tags"))
    return rows.select("p_partkey", kinds.classified(F.col("tags")).alias("c"), kinds.is_area(F.col("tags"), F.col("p_size") > 10).alias("area")).select("p_partkey", "c.kind", "c.subtype", "area")


WAY = Made(
    "p_partkey",
    {
        "highway": ["footway", None, "service", "Pedestrian", "track", "living_street", "primary", "queue"], "area:highway": [None, "queue", None], "footway": [*_no, "queue"], "access": [None, "customers", None, "permit", None, "yes", "Private"], "name": ["Main walk", "Entrance line", None, "The queue"],
        "queue": [*_no, "yes", "no"], "queue:line": [*_no, *_no, "designated"], "attraction": [*_no, *_no, "queue"], "foot": [*_no, "no", None], "service": [*_no, *_no, "alley", ""], "staff": [*_no, *_no, "yes"], "bridge": [None, "yes", "no", ""], "man_made": [*_no, "bridge"], "tunnel": [None, "yes", "0", "building_passage"], "location": [*_no, "Underground"],
        "colour": ["#F00", "grey", "dark_grey", "rgb(1, 2,255)", "rgb(1,2,256)", "0a0B0c", "nothing", None], "kind": ["path", "road"],
    },
)


def path_roles(spark: SparkSession, d: str) -> DataFrame:
    tags = F.col("tags")
    rgb = kinds.colour(tags["colour"])
    return read(spark, d, "part").select("p_partkey", WAY.tags().alias("tags")).select(
        "p_partkey", kinds.path_role(tags, tags["kind"]).alias("role"), kinds.bridge(tags).alias("bridge"), kinds.tunnel(tags).alias("tunnel"), (rgb.r * 65536 + rgb.g * 256 + rgb.b).alias("rgb")
    )


QUERIES = {f.__name__: f for f in (typed_relations, surface_heights, height_candidates, tag_kinds, path_roles)}

_NODE = """(SELECT vec_id AS id, list_extract(['ride-support', 'ride-track', 'building', 'path', 'barrier', 'bridge', 'water'], vec_id % 7 + 1) AS type, floor(CAST(embedding[1] AS DOUBLE)*1000) AS x0, floor(CAST(embedding[1] AS DOUBLE)*1000) + 6 AS x1,
 floor(CAST(embedding[2] AS DOUBLE)*1000) AS z0, floor(CAST(embedding[2] AS DOUBLE)*1000) + 4 AS z1, CASE WHEN vec_id % 5 <> 0 THEN label / 2.0::DOUBLE END AS base, CASE WHEN vec_id % 3 <> 0 THEN 0.5::DOUBLE END AS confidence FROM embeddings)"""
_RULES = ", ".join(f"('{n}', '{a}', '{b}', {r}::DOUBLE, {m}, {p}, {s}::DOUBLE)" for n, a, b, r, m, p, s in relations.RELATIONS)
ORACLE_SQL = {
    "typed_relations": f"""
WITH rules AS (SELECT * FROM (VALUES {_RULES}) v(type, lt, rt, reach, most, priority, scale)),
e AS (SELECT rules.type, l.id AS a, r.id AS b, priority, most, scale, reach, sqrt(pow(greatest(0, l.x0 - r.x1, r.x0 - l.x1), 2) + pow(greatest(0, l.z0 - r.z1, r.z0 - l.z1), 2)) AS dist, r.base - l.base AS step, least(coalesce(l.confidence, 0.8::DOUBLE), coalesce(r.confidence, 0.8::DOUBLE)) AS c
 FROM rules JOIN {_NODE} l ON l.type = lt JOIN {_NODE} r ON r.type = rt),
k AS (SELECT * FROM e WHERE dist <= reach QUALIFY row_number() OVER (PARTITION BY type, a ORDER BY dist, b) <= most)
SELECT type, CASE WHEN type = 'path-connects-building' THEN b ELSE a END AS from_id, CASE WHEN type = 'path-connects-building' THEN a ELSE b END AS to_id, priority, floor(dist * 1000 + 0.5) / 1000 AS distance_m,
 CASE WHEN step IS NULL THEN 'unresolved' WHEN abs(step) < 0.75 THEN 'same-level' WHEN step > 0 THEN 'above' ELSE 'below' END AS vertical, floor(c * greatest(0.35::DOUBLE, 1 - dist / scale) * 1000 + 0.5) / 1000 AS confidence FROM k""",
    "surface_heights": """
WITH s AS (SELECT l_suppkey, CASE WHEN l_extendedprice / 1000 - l_quantity BETWEEN 1.5 AND 80 THEN l_extendedprice / 1000 - l_quantity END AS h FROM lineitem),
g AS (SELECT l_suppkey, CAST(count(h) AS INT) AS n, count(*) AS cells, floor(quantile_cont(h, 0.65) * 10 + 0.5) / 10 AS height, floor((quantile_cont(h, 0.9) - quantile_cont(h, 0.1)) * 10 + 0.5) / 10 AS spread FROM s GROUP BY 1)
SELECT l_suppkey, n, CASE WHEN n >= 4 AND n / cells >= 0.35 THEN height END AS height, CASE WHEN n >= 4 AND n / cells >= 0.35 THEN spread END AS spread,
 CASE WHEN n >= 4 AND n / cells >= 0.35 THEN least(0.99::DOUBLE, floor((0.45::DOUBLE + 0.25::DOUBLE * (n / cells) + 0.2::DOUBLE * least(1.0, log2(n + 1) / 7) + 0.1::DOUBLE * greatest(0.0, 1 - spread / greatest(6.0, height))) * 1000 + 0.5) / 1000) END AS confidence FROM g""",
    "height_candidates": """
WITH h AS (SELECT l_suppkey, l_extendedprice / 2000 - l_quantity / 10 AS h, l_partkey % 7 AS class FROM lineitem),
b AS (SELECT l_suppkey, CAST(floor(h / 0.5 + 0.5) AS BIGINT) AS bin, count(*) AS n, quantile_cont(h, 0.5) AS height, avg(CASE WHEN class IN (0, 1) THEN 1.0::DOUBLE ELSE 0 END) AS u FROM h WHERE h BETWEEN 0.45 AND 80 GROUP BY 1, 2),
q AS (SELECT *, floor((1.35::DOUBLE * log2(n + 1) + 0.35::DOUBLE * u - 0.008::DOUBLE * height) * 1e6 + 0.5) / 1e6 AS quality FROM b)
SELECT l_suppkey, bin, n, height, quality, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY quality DESC, bin) AS INT) AS place FROM q) WHERE place <= 8""",
    "tag_kinds": f"""
WITH t AS (SELECT p_partkey, p_size, {', '.join(f"nullif(\"{n}\", '') AS \"{n}\"" for n in (x.replace(':', '_') for x in TAGS.lists))} FROM (SELECT p_partkey, p_size, {TAGS.sql()} FROM part)),
k AS (SELECT p_partkey, area, p_size, building, landuse, leisure, "natural", tourism, attraction, water, amenity, man_made, area_highway, CASE
 WHEN tourism = 'theme_park' THEN 'park_boundary|theme_park' WHEN roller_coaster = 'track' THEN 'ride_track|' || coalesce(roller_coaster_track, 'coaster') WHEN roller_coaster = 'support' THEN 'ride_support|support'
 WHEN man_made = 'ride_attachment' OR ride_attachment IS NOT NULL THEN 'ride_attachment|' || coalesce(ride_attachment, 'ride-attachment') WHEN roller_coaster = 'station' THEN 'building|coaster_station'
 WHEN building IS NOT NULL THEN 'building|' || building WHEN attraction IS NOT NULL THEN 'attraction|' || attraction WHEN barrier = 'hedge' THEN 'vegetation|hedge'
 WHEN "natural" IN ('tree', 'tree_row', 'wood', 'scrub', 'shrub', 'bush') THEN 'vegetation|' || "natural" WHEN landuse IN ('forest', 'orchard', 'vineyard', 'plant_nursery') THEN 'vegetation|' || landuse
 WHEN landcover IN ('trees', 'tree_cover', 'shrubs', 'scrub') THEN 'vegetation|' || landcover WHEN "natural" IN ('rock', 'stone', 'boulder', 'cliff') THEN 'terrain_detail|' || "natural" WHEN geological IN ('outcrop', 'boulder') THEN 'terrain_detail|' || geological
 WHEN area_highway IS NOT NULL THEN CASE WHEN lower(area_highway) IN ('footway', 'path', 'pedestrian', 'steps', 'corridor', 'cycleway') THEN 'path' ELSE 'road' END || '|area:' || lower(area_highway)
 WHEN highway IS NOT NULL THEN CASE WHEN highway IN ('footway', 'path', 'pedestrian', 'steps', 'corridor', 'cycleway', 'bridleway') THEN 'path' ELSE 'road' END || '|' || highway
 WHEN "natural" = 'water' OR water IS NOT NULL OR waterway IS NOT NULL OR leisure = 'swimming_pool' THEN 'water|' || coalesce(water, waterway, "natural", leisure) WHEN railway IS NOT NULL THEN 'rail|' || railway WHEN barrier IS NOT NULL THEN 'barrier|' || barrier
 WHEN coalesce(landuse, landcover, "natural", leisure) IS NOT NULL THEN 'surface|' || coalesce(landuse, landcover, "natural", leisure) WHEN man_made IS NOT NULL THEN 'structure|' || man_made WHEN amenity IS NOT NULL THEN 'amenity|' || amenity WHEN shop IS NOT NULL THEN 'amenity|shop:' || shop
 WHEN entrance IS NOT NULL THEN 'detail|entrance:' || entrance WHEN door IS NOT NULL THEN 'detail|door:' || door WHEN historic IS NOT NULL THEN 'detail|historic:' || historic WHEN information IS NOT NULL THEN 'detail|information:' || information
 WHEN playground IS NOT NULL THEN 'detail|playground:' || playground WHEN public_transport IS NOT NULL THEN 'detail|public_transport:' || public_transport WHEN tourism IS NOT NULL THEN 'amenity|tourism:' || tourism END AS found FROM t)
SELECT p_partkey, string_split(found, '|')[1] AS kind, string_split(found, '|')[2] AS subtype, p_size > 10 AND coalesce(area, '') <> 'no' AND (coalesce(area = 'yes', false) OR coalesce(tourism = 'theme_park', false) OR coalesce(building, landuse, leisure, "natural", attraction, water, amenity, man_made, area_highway) IS NOT NULL) AS area FROM k""",
    "path_roles": f"""
WITH t AS (SELECT p_partkey, {WAY.sql()} FROM part), w AS (SELECT *, lower(coalesce(nullif(highway, ''), area_highway, '')) AS way, lower(coalesce(access, '')) AS acc FROM t)
SELECT p_partkey, CASE WHEN coalesce(queue = 'yes', false) OR coalesce(queue_line = 'designated', false) OR coalesce(footway = 'queue', false) OR coalesce(attraction = 'queue', false) OR way = 'queue' OR (acc = 'customers' AND coalesce(name IN ('Entrance line', 'The queue'), false)) THEN 'queue'
 WHEN acc IN ('permit', 'private') OR coalesce(foot = 'no', false) OR way IN ('service', 'track') OR coalesce(service = 'alley', false) OR coalesce(staff = 'yes', false) OR (kind = 'road' AND way NOT IN ('pedestrian', 'living_street')) THEN 'service' ELSE 'guest' END AS role,
 coalesce(bridge = 'yes', false) OR coalesce(man_made = 'bridge', false) AS bridge, coalesce(tunnel IN ('yes', 'building_passage'), false) OR coalesce(location = 'Underground', false) AS tunnel,
 CASE colour WHEN '#F00' THEN 255 * 65536 WHEN 'grey' THEN 128 * 65793 WHEN 'dark_grey' THEN 75 * 65793 WHEN 'rgb(1, 2,255)' THEN 65536 + 512 + 255 WHEN '0a0B0c' THEN 10 * 65536 + 11 * 256 + 12 END AS rgb FROM w""",
}
