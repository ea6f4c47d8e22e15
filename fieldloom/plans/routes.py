"""Queries over paths, corroboration, regions and voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.numbers import half_up
from fieldloom.operators import paths, regions
from fieldloom.plans.tables import points, read, track


def gap_repairs(spark: SparkSession, d: str) -> DataFrame:
    role = F.element_at(F.array(F.lit("queue"), F.lit("guest"), F.lit("service")), (F.pmod(F.col("vec_id"), F.lit(3)) + 1).cast("int"))
    ends = points(spark, d).select(F.col("vec_id").alias("id"), F.pmod(F.col("vec_id"), F.lit(50)).alias("line"), "x", "z", role.alias("role"), F.when(F.col("kind") > 4, 1).alias("level"))
    return paths.gap_repairs(ends, 30.0).withColumn("distance", half_up(F.col("distance"), 3))


def entrance_buildings(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    doors = p.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), "x", "z", F.col("kind").alias("rank"))
    found = paths.entrances(doors, p.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("id"), "x", "z"), 40.0)
    return found.select("building", "door", "rank")


def shape_labels(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    found = paths.labelled(p.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), "x", "z", (F.col("kind") * 100).alias("priority")), p.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("id"), "x", "z"), 60.0, 8)
    return found.withColumn("score", half_up(F.col("score"), 3))


def anchor_thinning(spark: SparkSession, d: str) -> DataFrame:
    kept = paths.thinned(track(spark, d).filter("elevation is not null"), "track_id", "measure", [F.col("seq")], 30.0)
    return kept.select("track_id", "measure")


def tunnel_elevation(spark: SparkSession, d: str) -> DataFrame:
    rows = track(spark, d).withColumn("ground", 1000 * F.col("seq") + 5000.0)
    return paths.tunnel_elevations(rows, ["track_id"], "measure", "elevation", "ground", 4.0).select("track_id", "seq", half_up(F.col("filled"), 3).alias("filled"))


def corroboration(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    samples = p.filter("vec_id % 2 = 0").select(F.pmod(F.col("vec_id"), F.lit(25)).alias("feature"), F.col("vec_id").alias("n"), "x", "z")
    return paths.corroborated(samples, p.filter("vec_id % 2 = 1").select("x", "z"), "feature", 12.0, 6, 0.5)


def terrain_grades(spark: SparkSession, d: str) -> DataFrame:
    rows = track(spark, d).withColumn("elevation", F.col("elevation") / 10000)
    return paths.grades(rows, ["track_id"], "measure", "elevation").select("track_id", half_up(F.col("p90"), 4).alias("p90"), "n", "status")


def route_widths(spark: SparkSession, d: str) -> DataFrame:
    found = paths.robust_widths(read(spark, d, "lineitem").select("l_partkey", (F.col("l_quantity") / 5).alias("w")), ["l_partkey"], "w")
    return found.select("l_partkey", "n", half_up(F.col("deviation"), 4).alias("deviation"), half_up(F.col("width"), 4).alias("width"), half_up(F.col("range"), 4).alias("spread"), "accepted")


def cell_regions(spark: SparkSession, d: str) -> DataFrame:
    cells = points(spark, d).select(F.floor(F.col("x") / 12).cast("bigint").alias("x"), F.floor(F.col("z") / 12).cast("bigint").alias("z"))
    return regions.large_regions(cells, 2).drop("region")


def voxel_precedence(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    c = lambda n: F.col(n).cast("double")
    cells = p.select("vec_id", "kind", F.explode(regions.voxel_line(c("x"), c("kind"), c("z"), c("x") + 6, c("kind") * 2, c("z") - 3)).alias("c")).select("c.*", "vec_id", "kind")
    return regions.precedence(cells, F.col("kind"), "vec_id")


QUERIES = {f.__name__: f for f in (gap_repairs, entrance_buildings, shape_labels, anchor_thinning, tunnel_elevation, corroboration, terrain_grades, route_widths, cell_regions, voxel_precedence)}

_PTS = "(SELECT vec_id, CAST(floor(CAST(embedding[1] AS DOUBLE)*1000) AS BIGINT) AS x, CAST(floor(CAST(embedding[2] AS DOUBLE)*1000) AS BIGINT) AS z, label AS kind FROM embeddings)"
_TRACK = """(SELECT l_orderkey AS track_id, CAST(row_number() OVER w AS INT) AS seq, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS measure, CASE WHEN l_discount <> 0.05 THEN l_extendedprice END AS elevation
 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))"""
_D = "sqrt((a.x-b.x)*(a.x-b.x)+(a.z-b.z)*(a.z-b.z))"
ORACLE_SQL = {
    "gap_repairs": f"""
WITH e AS (SELECT vec_id AS id, vec_id % 50 AS line, x, z, list_extract(['queue', 'guest', 'service'], vec_id % 3 + 1) AS role, kind > 4 AS level FROM {_PTS}),
p AS (SELECT a.id, b.id AS to_id, {_D} AS distance, a.role = b.role AS same FROM e a JOIN e b ON a.line <> b.line AND a.level = b.level AND (a.role = b.role OR (a.role NOT IN ('queue', 'service') AND b.role NOT IN ('queue', 'service'))) WHERE {_D} BETWEEN 0.2 AND 30),
q AS (SELECT *, floor(least(0.96::DOUBLE, 0.62::DOUBLE + 0.2::DOUBLE * greatest(0.0, 1 - distance / 30) + 0.04::DOUBLE * CASE WHEN same THEN 1.0::DOUBLE ELSE 0.7 END) * 1000 + 0.5) / 1000 AS confidence FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, to_id) = 1)
SELECT id, to_id, floor(distance * 1000 + 0.5) / 1000 AS distance, confidence, confidence >= 0.72 AS accepted FROM q""",
    "entrance_buildings": f"""
WITH n AS (SELECT a.vec_id AS door, a.kind AS rank, b.vec_id AS building FROM {_PTS} a JOIN {_PTS} b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 WHERE {_D} <= 40 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D}, b.vec_id) = 1)
SELECT building, door, rank FROM n QUALIFY row_number() OVER (PARTITION BY building ORDER BY rank DESC, door) = 1""",
    "shape_labels": f"""
WITH m AS (SELECT a.vec_id AS label, b.vec_id AS shape, {_D} - 0.08::DOUBLE * a.kind * 100 AS score FROM {_PTS} a JOIN {_PTS} b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 WHERE {_D} <= 60),
f AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY label) <= 8)
SELECT label, shape, floor(score * 1000 + 0.5) / 1000 AS score FROM f QUALIFY row_number() OVER (PARTITION BY shape ORDER BY score, label) = 1""",
    "anchor_thinning": f"""
WITH RECURSIVE t AS (SELECT track_id, measure, row_number() OVER (PARTITION BY track_id ORDER BY measure, seq) AS n FROM {_TRACK} WHERE elevation IS NOT NULL),
k AS (SELECT track_id, n, measure, measure AS last, true AS kept FROM t WHERE n = 1 UNION ALL SELECT t.track_id, t.n, t.measure, CASE WHEN t.measure - k.last < 30 THEN k.last ELSE t.measure END, t.measure - k.last >= 30 FROM k JOIN t ON t.track_id = k.track_id AND t.n = k.n + 1)
SELECT track_id, measure FROM k WHERE kept""",
    "tunnel_elevation": f"""
WITH t AS (SELECT *, last_value(CASE WHEN elevation IS NOT NULL THEN measure END IGNORE NULLS) OVER a AS am, last_value(elevation IGNORE NULLS) OVER a AS av, first_value(CASE WHEN elevation IS NOT NULL THEN measure END IGNORE NULLS) OVER b AS bm, first_value(elevation IGNORE NULLS) OVER b AS bv FROM {_TRACK}
 WINDOW a AS (PARTITION BY track_id ORDER BY measure ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY track_id ORDER BY measure ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT track_id, seq, floor(coalesce(elevation, CASE WHEN bm - am > 0 THEN least(av + (bv - av) * (measure - am) / (bm - am), 1000 * seq + 5000 - 4) END) * 1000 + 0.5) / 1000 AS filled FROM t""",
    "corroboration": f"""
WITH h AS (SELECT vec_id % 25 AS feature, vec_id, EXISTS (SELECT 1 FROM {_PTS} b WHERE b.vec_id % 2 = 1 AND {_D} <= 12) AS hit FROM {_PTS} a WHERE vec_id % 2 = 0)
SELECT feature, count(*) AS samples, count(*) FILTER (WHERE hit) AS hits, count(*) >= 6 AND count(*) FILTER (WHERE hit) / count(*) >= 0.5 AS corroborated FROM h GROUP BY 1""",
    "terrain_grades": f"""
WITH s AS (SELECT track_id, measure - lag(measure) OVER w AS run, abs(elevation / 10000 - lag(elevation / 10000) OVER w) AS rise FROM {_TRACK} WHERE elevation IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY measure)),
g AS (SELECT track_id, quantile_cont(100 * rise / run, 0.9) AS p90, count(*) AS n FROM s WHERE run > 0 GROUP BY 1)
SELECT track_id, floor(p90 * 10000 + 0.5) / 10000 AS p90, n, CASE WHEN p90 > 16 THEN 'steep' WHEN p90 > 8.3 THEN 'ramp' ELSE 'level' END AS status FROM g""",
    "route_widths": """
WITH s AS (SELECT l_partkey, l_quantity / 5 AS w FROM lineitem), m AS (SELECT l_partkey, quantile_cont(w, 0.5) AS m FROM s GROUP BY 1), o AS (SELECT s.l_partkey, w, m, abs(w - m) AS off FROM s JOIN m USING (l_partkey)),
v AS (SELECT l_partkey, quantile_cont(off, 0.5) AS deviation FROM o GROUP BY 1)
SELECT l_partkey, count(*) AS n, floor(any_value(deviation) * 10000 + 0.5) / 10000 AS deviation, floor(quantile_cont(w, 0.5) * 10000 + 0.5) / 10000 AS width, floor((quantile_cont(w, 0.9) - quantile_cont(w, 0.1)) * 10000 + 0.5) / 10000 AS spread, count(*) >= 3 AS accepted
FROM o JOIN v USING (l_partkey) WHERE off <= greatest(1.5::DOUBLE, 3 * deviation, 0.4::DOUBLE * m) GROUP BY 1""",
    "cell_regions": f"""
WITH RECURSIVE c AS (SELECT DISTINCT CAST(floor(x / 12) AS BIGINT) AS x, CAST(floor(z / 12) AS BIGINT) AS z FROM {_PTS}), r(x, z, rx, rz) AS (SELECT x, z, x, z FROM c UNION SELECT c.x, c.z, r.rx, r.rz FROM r JOIN c ON abs(c.x - r.x) + abs(c.z - r.z) = 1),
l AS (SELECT x, z, min((rz, rx)) AS root FROM r GROUP BY 1, 2)
SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z FROM l GROUP BY root HAVING count(*) >= 2""",
    "voxel_precedence": f"""
WITH s AS (SELECT *, greatest(6, kind) AS steps FROM {_PTS}), v AS (SELECT DISTINCT vec_id, kind, CAST(floor(x + 6.0::DOUBLE * i / steps + 0.5) AS BIGINT) AS x, CAST(floor(kind + kind::DOUBLE * i / steps + 0.5) AS BIGINT) AS y, CAST(floor(z - 3.0::DOUBLE * i / steps + 0.5) AS BIGINT) AS z FROM s, range(0, 100) r(i) WHERE i <= steps)
SELECT x, y, z, arg_max(vec_id, (kind, vec_id)) AS vec_id, max(kind) AS kind FROM v GROUP BY 1, 2, 3""",
}
