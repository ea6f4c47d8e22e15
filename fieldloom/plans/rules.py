"""Queries over drawings, nodes of the graph and their models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.numbers import half_up
from fieldloom.operators import drawings, nodes
from fieldloom.plans.made import Made, literal
from fieldloom.plans.tables import points, read

DRAWING = Made(
    "p_partkey",
    {
        "title": ["Site Plan", "Elevation A", None, "Proposed roof plan and sections", "Schedule of drains", "Notes", "Ride  layout", "Key plan"], "description": [None, "sheet 2", "specification"],
        "role": ["site-layout", "elevations-and-sections", None, "water-and-drainage", "planning-document", ""], "page": ["text only", "General   arrangement", None, "MASTERPLAN", "legend"],
    },
)
ANCHOR = Made(
    "p_partkey",
    {
        "text": ["Existing path", "Drawing No 12", "ST10 4DB", "12 High Street, Alton", "Legend", "New oak tree", "", None, "Indicated thus", "Scale 1:500", "Kiosk", "  Retained\twall "], "cx": [10.0, 79.0, 50.0, None, 95.0], "cy": [10.0, 89.0, 50.0],
    },
)
SHAPE = Made("p_partkey", {"kind": ["building", "ride_support", "path", None, "ride_attachment", "water"], "closed": [True, False, None], "w": [100.0, 2600.0, 0.1, 4100.0, 500.0], "h": [50.0, 3100.0, 0.0, 900.0], "fill": [0.5, 0.01, 0.002, 0.03], "scale": [0.1, 0.0, None, 0.05, 1.0]})
NODE = Made(
    "p_partkey",
    {
        "kind": ["path", "road", "water", "detail", "park_boundary", "terrain_detail", "ride_track", "unheard", "building", None], "subtype": [None, "Boardwalk", "footway", "underpass", "x"], "bridge": [None, "yes", "no", None, ""], "tunnel": [None, None, "culvert", "false"], "man_made": [None, "Support", "mast"],
        "surface": [None, "asphalt", ""], "material": ["brick", None, None], "fused": [None, "stone"], "observed": [None, None, "gravel"], "state": [None, "Proposed", ""], "feature_state": [None, "built", None], "ffl_m": [None, "101.25", "n/a"],
        "ground": [100.12345, None], "stated": [None, 103.5, None], "least": [None, 2.0], "height": [7.25, None, 4.0], "a": [0.9, None, 0.41239], "b": [None, 0.7], "planning_vertical_relationship": [*[None] * 6, "over"],
    },
)


def _named(made: Made, *names: str) -> list[Column]:
    return [made.column(n) for n in names]


def drawing_views(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", drawings.view(*_named(DRAWING, "title", "description", "role", "page")).alias("v")).select("p_partkey", "v.*")


def label_anchors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", drawings.anchor_allowed(*_named(ANCHOR, "text", "cx", "cy"), F.lit(100.0), F.lit(100.0)).alias("allowed"))


def shape_sizes(spark: SparkSession, d: str) -> DataFrame:
    w, h, fill = _named(SHAPE, "w", "h", "fill")
    return read(spark, d, "part").select("p_partkey", drawings.shape_allowed(*_named(SHAPE, "kind", "closed"), w, h, w * h * fill, SHAPE.column("scale")).alias("allowed"))


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    x, z = F.col("x") / 4.0, F.col("z") / 4.0
    side = 3.0 + F.pmod(F.col("vec_id"), F.lit(19))
    return points(spark, d).select("vec_id", F.pmod(F.col("vec_id"), F.lit(7)).alias("page"), x.alias("min_x"), z.alias("min_y"), (x + side).alias("max_x"), (z + side / 2).alias("max_y"), (F.col("vec_id") % 3 != 0).alias("closed"), side.alias("length"))


def text_glyphs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    boxes = read(spark, d, "customer").select(
        F.pmod(k, F.lit(7)).alias("page"), (F.pmod(k * 37, F.lit(900)) / 4.0 - 110).alias("x0"), (F.pmod(k * 53, F.lit(900)) / 4.0 - 110).alias("y0"), F.pmod(k, F.lit(90)).alias("w"), F.pmod(k, F.lit(23)).alias("h"), F.col("c_mktsegment").alias("text"), (F.pmod(k, F.lit(10)) / 10.0).alias("confidence")
    )
    boxes = boxes.select("page", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), "text", "confidence")
    return drawings.glyphs(_shapes(spark, d), boxes, "page").select("vec_id")


def anchor_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d).select("vec_id", F.pmod(F.col("vec_id"), F.lit(3)).alias("page"), F.col("kind").alias("class"), F.pmod(F.col("x"), F.lit(5)).cast("double").alias("cx"), (F.pmod(F.col("z"), F.lit(7)) + 0.04).alias("cy"), F.when(F.col("vec_id") % 2 == 0, "Path").otherwise("PATH").alias("text"))
    return drawings.merged_anchors(rows, ["vec_id"]).select("vec_id", "page", "class")


LEAST = {"path": 100, "building": 10**9, "ride_track": 1}


def spatial_contract(spark: SparkSession, d: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("path", "building", "ride_track"))), F.pmod(F.col("vec_id"), F.lit(3)).cast("int"))
    label = F.when(F.col("vec_id") % 5 == 0, "Max dimensions").when(F.col("vec_id") % 5 == 1, "Clearance envelope").otherwise("Track")
    rows = points(spark, d).select(
        kind.alias("kind"), *(F.col(c).cast("double").alias(f"{side}_{c}") for side in ("min", "max") for c in "xz"), (F.col("vec_id") % 4 == 0).alias("automatic"), (F.col("vec_id") % 8 == 0).alias("registered"), F.pmod(F.col("vec_id"), F.lit(70)).alias("fanout"), label.alias("label")
    )
    got = drawings.spatial_contract(rows, (-100.0, -90.0, 100.0, 95.0), (0.5, 4.0), LEAST)
    return got.select("status", F.array_join("failures", "; ").alias("failures"), "features", "outside", half_up(F.col("ratio_x"), 4).alias("ratio_x"), half_up(F.col("ratio_z"), 4).alias("ratio_z"))


def node_types(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", nodes.node_type(*_named(NODE, "kind", "subtype"), NODE.tags("bridge", "tunnel", "man_made")).alias("type"))


def node_models(spark: SparkSession, d: str) -> DataFrame:
    tags = F.col("tags")
    rows = read(spark, d, "part").select("p_partkey", *(NODE.column(n).alias(n) for n in ("ground", "stated", "least", "height", "fused", "observed", "a", "b")), NODE.tags("bridge", "tunnel", "surface", "material", "state", "feature_state", "ffl_m", "planning_vertical_relationship").alias("tags"))
    v = nodes.vertical(F.col("ground"), F.lit(None).cast("string"), F.col("stated"), F.col("least"), F.col("height"), tags)
    m = nodes.material(tags, F.col("fused"), F.col("observed"))
    return rows.select(
        "p_partkey", v["ground"].alias("ground"), v["base"].alias("base"), v["top"].alias("top"), v["relation"].alias("relation"), F.size(v["evidence"]).alias("records"), m["resolved"].alias("material"), F.array_join(m["evidence"], ",").alias("materials"),
        nodes.lifecycle(tags).alias("state"), nodes.trust(F.col("a"), F.col("b")).alias("trust"),
    )


def geometry_models(spark: SparkSession, d: str) -> DataFrame:
    corner = lambda x, z: F.struct(x.cast("double").alias("x"), z.cast("double").alias("z"))
    x, z, n = F.col("x"), F.col("z"), F.col("vec_id") % 9 + 1
    names = ("Point", "LineString", "MultiPolygon", "MultiPoint", "GeometryCollection")
    kind = F.get(F.array(*map(F.lit, names)), F.pmod(F.col("vec_id"), F.lit(5)).cast("int"))
    said = F.concat_ws(",", z / 100, x / 100, F.col("kind") / 10 + z / 100, x / 100 + 0.5, F.when(F.col("vec_id") % 11 == 0, "1"))
    rows = points(spark, d).select("vec_id", nodes.vertex_mean(F.array(corner(x, z), corner(x + n, z), corner(x + n, z + n), corner(x, z))).alias("c"), kind.alias("g"), nodes.bbox(said).alias("b"))
    return rows.select("vec_id", "c.x", "c.z", nodes.dimension(F.col("g")).alias("dimension"), half_up(F.col("b.lat"), 6).alias("lat"), half_up(F.col("b.km2"), 4).alias("km2"))


QUERIES = {f.__name__: f for f in (drawing_views, label_anchors, shape_sizes, text_glyphs, anchor_merge, spatial_contract, node_types, node_models, geometry_models)}

_q = literal
_PTS = "(SELECT vec_id, CAST(floor(CAST(embedding[1] AS DOUBLE)*1000) AS BIGINT) AS x, CAST(floor(CAST(embedding[2] AS DOUBLE)*1000) AS BIGINT) AS z, label AS kind FROM embeddings)"
_plan = lambda c: f"regexp_matches({c}, {_q(drawings.PLAN_VIEW)})"
_trim = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
ORACLE_SQL = {
    "drawing_views": f"""
WITH v AS (SELECT p_partkey, {DRAWING.sql()} FROM part), t AS (SELECT p_partkey, {_trim("concat_ws(' ', title, description)")} AS named, lower(coalesce(nullif(role, ''), 'planning-document')) AS role, {_trim('page')} AS page FROM v),
r AS (SELECT p_partkey, CASE WHEN {_plan('named')} THEN 'document-title-plan-view' WHEN role = 'elevations-and-sections' THEN 'document-role-elevations-and-sections' WHEN regexp_matches(named, {_q(drawings.NON_PLAN_VIEW)}) THEN 'document-title-non-plan-view'
 WHEN role = 'water-and-drainage' AND regexp_matches(named, '(?i)\\bschedule\\b') THEN 'drainage-schedule-not-plan-view' WHEN role IN ('site-layout', 'water-and-drainage') THEN 'document-role-' || role WHEN {_plan('page')} THEN 'page-title-plan-view' ELSE 'plan-view-not-established' END AS reason FROM t)
SELECT p_partkey, reason NOT IN ('document-role-elevations-and-sections', 'document-title-non-plan-view', 'drainage-schedule-not-plan-view', 'plan-view-not-established') AS eligible,
 CASE WHEN reason IN ('document-role-elevations-and-sections', 'document-title-non-plan-view', 'drainage-schedule-not-plan-view', 'plan-view-not-established') THEN 'evidence-only' ELSE 'plan-view' END AS status, reason FROM r""",
    "label_anchors": f"""
SELECT p_partkey, coalesce(text IN ('Existing path', 'New oak tree', '  Retained\twall ') OR (text = 'Kiosk' AND NOT (cx IS NOT NULL AND (cx > 78 OR cy > 88))), false) AS allowed FROM (SELECT p_partkey, {ANCHOR.sql()} FROM part)""",
    "shape_sizes": f"""
WITH s AS (SELECT p_partkey, coalesce(kind, '') AS kind, coalesce(closed, false) AS closed, w * scale AS w, h * scale AS h, fill, scale FROM (SELECT p_partkey, {SHAPE.sql()} FROM part)), m AS (SELECT *, greatest(w, h) AS span FROM s)
SELECT p_partkey, coalesce(scale > 0 AND span >= 0.02 AND NOT (kind = 'building' AND span > 250) AND NOT (kind = 'ride_support' AND span > 120) AND NOT (kind = 'ride_attachment' AND span > 400)
 AND NOT (closed AND w > 0 AND h > 0 AND ((kind = 'building' AND span > 40 AND fill < 0.012) OR (kind <> 'path' AND span > 300 AND fill < 0.0025))), false) AS allowed FROM m""",
    "text_glyphs": f"""
WITH s AS (SELECT vec_id, vec_id % 7 AS page, x / 4.0::DOUBLE AS x0, z / 4.0::DOUBLE AS y0, 3.0::DOUBLE + vec_id % 19 AS side, vec_id % 3 <> 0 AS closed FROM {_PTS}),
b AS (SELECT c_custkey % 7 AS page, (c_custkey * 37 % 900) / 4.0::DOUBLE - 110 AS x0, (c_custkey * 53 % 900) / 4.0::DOUBLE - 110 AS y0, c_custkey % 90 AS w, c_custkey % 23 AS h FROM customer WHERE c_custkey % 10 >= 7 AND c_custkey % 90 > 0 AND c_custkey % 23 > 0 AND length(c_mktsegment) >= 2),
p AS (SELECT *, greatest(1.5::DOUBLE, least(4.0::DOUBLE, h * 0.18::DOUBLE)) AS pad FROM b)
SELECT DISTINCT vec_id FROM s JOIN p ON s.page = p.page AND s.x0 >= p.x0 - pad AND s.x0 + side <= p.x0 + w + pad AND s.y0 >= p.y0 - pad AND s.y0 + side / 2 <= p.y0 + h + pad
WHERE CASE WHEN closed THEN (side / 2 <= greatest(8.0, h * 1.9) AND side <= greatest(12.0, h * 2.8)) OR (side / 2 <= h * 2.2 AND side * side / 2 / greatest(1.0, w * h) <= 0.24) ELSE side <= greatest(12.0, h * 3.2) END""",
    "anchor_merge": f"SELECT min(vec_id) AS vec_id, vec_id % 3 AS page, kind AS class FROM {_PTS} GROUP BY vec_id % 3, kind, ((x % 5) + 5) % 5, ((z % 7) + 7) % 7",
    "spatial_contract": f"""
WITH f AS (SELECT *, x < -100 OR z < -90 OR x > 100 OR z > 95 AS outside, vec_id % 4 = 0 AND vec_id % 8 <> 0 AS loose, vec_id % 70 > 64 AS fan, vec_id % 3 = 2 AND vec_id % 5 < 2 AS envelope FROM {_PTS}),
g AS (SELECT count(*) AS features, count_if(outside) AS outside, count_if(loose) AS loose, count_if(fan) AS fan, count_if(envelope) AS envelope, (max(x) - min(x)) / 201.0::DOUBLE AS rx, (max(z) - min(z)) / 186.0::DOUBLE AS rz, count_if(vec_id % 3 = 0) AS paths, count_if(vec_id % 3 = 1) AS buildings, count_if(vec_id % 3 = 2) AS tracks FROM f),
l AS (SELECT *, concat_ws('; ', CASE WHEN rx < 0.5 THEN 'x span' END, CASE WHEN rz < 4 THEN 'z span' END, CASE WHEN outside > 0 THEN 'outside: ' || outside END, CASE WHEN loose > 0 THEN 'unregistered: ' || loose END, CASE WHEN fan > 0 THEN 'fan-out: ' || fan END, CASE WHEN envelope > 0 THEN 'envelopes: ' || envelope END,
 CASE WHEN paths < 100 THEN 'path: ' || paths || ' of 100' END, CASE WHEN buildings < 1000000000 THEN 'building: ' || buildings || ' of 1000000000' END, CASE WHEN tracks < 1 THEN 'ride_track: ' || tracks || ' of 1' END) AS failures FROM g)
SELECT CASE WHEN failures <> '' THEN 'failed' ELSE 'passed' END AS status, failures, features, outside, floor(rx * 10000 + 0.5) / 10000 AS ratio_x, floor(rz * 10000 + 0.5) / 10000 AS ratio_z FROM l""",
    "node_types": f"""
SELECT p_partkey, CASE WHEN kind IN ('path', 'road') THEN CASE WHEN coalesce(bridge = 'yes', false) OR coalesce(subtype = 'Boardwalk', false) THEN 'bridge' WHEN coalesce(tunnel = 'culvert', false) OR coalesce(subtype = 'underpass', false) THEN 'tunnel' ELSE kind END
 WHEN kind = 'detail' THEN CASE WHEN man_made = 'Support' THEN 'ride-support' ELSE 'detail' END WHEN kind = 'terrain_detail' THEN 'terrain-detail' WHEN kind = 'ride_track' THEN 'ride-track' WHEN kind IN ('water', 'building') THEN kind END AS type FROM (SELECT p_partkey, {NODE.sql()} FROM part)""",
    "node_models": f"""
WITH n AS (SELECT *, nullif(surface, '') AS s FROM (SELECT p_partkey, {NODE.sql()} FROM part))
SELECT p_partkey, floor(ground * 1000 + 0.5) / 1000 AS ground, floor(coalesce(stated, ground) * 1000 + 0.5) / 1000 AS base, floor((coalesce(stated, ground) + coalesce(least, 0) + height) * 1000 + 0.5) / 1000 AS top,
 CASE WHEN planning_vertical_relationship IS NOT NULL THEN planning_vertical_relationship WHEN bridge = 'yes' THEN 'bridge' WHEN tunnel = 'culvert' THEN 'tunnel' ELSE 'ground-associated' END AS relation,
 CAST((ground IS NOT NULL)::INT + (stated IS NOT NULL)::INT + (height IS NOT NULL)::INT + coalesce((ffl_m = '101.25')::INT, 0) AS INT) AS records, coalesce(s, material, fused, observed) AS material,
 concat_ws(',', s || '@planning-or-feature-surface', material || '@planning-or-feature-material', fused || '@fidelity-fusion', observed || '@orthophoto-evidence') AS materials,
 lower(coalesce(feature_state, nullif(state, ''), 'unspecified')) AS state, floor(least(a, b) * 1000 + 0.5) / 1000 AS trust FROM n""",
    "geometry_models": f"""
WITH p AS (SELECT *, vec_id % 9 + 1 AS n, z / 100.0::DOUBLE AS s, x / 100.0::DOUBLE AS w, kind / 10.0::DOUBLE + z / 100.0::DOUBLE AS t, x / 100.0::DOUBLE + 0.5::DOUBLE AS e FROM {_PTS}),
o AS (SELECT *, vec_id % 11 <> 0 AND w < e AND s < t AND w >= -180 AND e <= 180 AND s >= -90 AND t <= 90 AS ok FROM p)
SELECT vec_id, floor((4 * x + 2 * n) / 4.0::DOUBLE * 1000 + 0.5) / 1000 AS x, floor((4 * z + n) / 4.0::DOUBLE * 1000 + 0.5) / 1000 AS z, CAST(list_extract([0, 1, 2, 0, NULL], vec_id % 5 + 1) AS INT) AS dimension,
 CASE WHEN ok THEN floor((s + t) / 2 * 1000000 + 0.5) / 1000000 END AS lat, CASE WHEN ok THEN floor((e - w) * (pi() / 180 * 6378137) * cos(radians((s + t) / 2)) * ((t - s) * (pi() / 180 * 6378137)) / 1000000 * 10000 + 0.5) / 10000 END AS km2 FROM o""",
}
