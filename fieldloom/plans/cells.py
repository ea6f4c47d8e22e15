"""Queries over cell tables, graphs and sequential operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions.numbers import half_up
from fieldloom.operators import graphs, raster
from fieldloom.plans.tables import points, read, track


def _cells(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return p.select(F.floor(F.col("x") / 8).cast("bigint").alias("x"), F.floor(F.col("z") / 8).cast("bigint").alias("z"), F.col("kind").cast("double").alias("h"), "vec_id").groupBy("x", "z").agg(F.max("h").alias("h"))


def cell_maxima(spark: SparkSession, d: str) -> DataFrame:
    return raster.cell_max(points(spark, d).withColumn("kind", F.col("kind").cast("double")), 8.0, "kind", "vec_id")


def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    return raster.local_maxima(_cells(spark, d), "h", 2.0)


def boundary_cells(spark: SparkSession, d: str) -> DataFrame:
    return raster.boundary_cells(_cells(spark, d))


def neighbour_majority(spark: SparkSession, d: str) -> DataFrame:
    return raster.majority(_cells(spark, d), fill=4, drop=1)


def median_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return raster.median_filter(_cells(spark, d), "h", 2.0).select("x", "z", "smoothed")


def overlay_paint(spark: SparkSession, d: str) -> DataFrame:
    layers = points(spark, d).select(F.floor(F.col("x") / 16).cast("bigint").alias("x"), F.floor(F.col("z") / 16).cast("bigint").alias("z"), F.col("kind").alias("layer"), "vec_id")
    return raster.painted(layers, F.pmod(F.col("layer"), F.lit(4)), "vec_id")


def scanline_cells(spark: SparkSession, d: str) -> DataFrame:
    v = lambda x, z: F.struct(x.cast("double").alias("x"), z.cast("double").alias("z"))
    k = F.col("n_nationkey")
    polygons = read(spark, d, "nation").select("n_nationkey", F.array(v(k, F.lit(-3)), v(k + 12, k), v(k + 5, k + 9), v(k - 6, k / 2 + 1)).alias("ring"))
    return raster.scanlines(polygons, "n_nationkey", "ring")


def chunk_split(spark: SparkSession, d: str) -> DataFrame:
    boxes = points(spark, d).select("vec_id", F.col("x").alias("x1"), F.col("z").alias("z1"), (F.col("x") + 3 * F.col("kind")).alias("x2"), (F.col("z") + 20).alias("z2"))
    return raster.split_chunks(boxes)


def bilinear_samples(spark: SparkSession, d: str) -> DataFrame:
    asked = points(spark, d).select("vec_id", (F.col("x") / 8).alias("ax"), (F.col("z") / 8).alias("az"))
    return raster.bilinear(asked, _cells(spark, d), "vec_id", "h").select("vec_id", half_up(F.col("h"), 6).alias("h"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.pmod(F.col("o_orderkey"), F.lit(700)) + 100000).alias("b"))


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graphs.components(_links(spark, d))


def network_summary(spark: SparkSession, d: str) -> DataFrame:
    return graphs.network_summary(_links(spark, d))


def greedy_spacing(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a part as points of one feature."""
    rows = read(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.pmod(F.col("l_orderkey") * 7, F.lit(211)).alias("x"), F.pmod(F.col("l_suppkey") * 13, F.lit(97)).alias("z"))
    return graphs.greedy_spacing(rows, "l_partkey", ["l_orderkey", "l_linenumber"], 40.0)


def continuity_choice(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 10.0).cast("double").alias("measure"), (F.col("l_quantity") + 0.0).alias("value"), (F.col("l_discount") * 100).alias("quality")).dropDuplicates(["l_orderkey", "l_linenumber", "value"])
    return graphs.continuity_choice(rows.drop("quality").withColumn("quality", F.pmod(F.col("value"), F.lit(7.0))), "l_orderkey", "l_linenumber", "measure", "value", "quality").select("l_orderkey", "l_linenumber", "value", "chosen")


def seeded_watershed(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d).withColumns({"tile": F.floor(F.col("x") / 16).cast("bigint") * 1000003 + F.floor(F.col("z") / 16).cast("bigint"), "seed": F.col("h") >= 8})
    return graphs.crowns(cells, "tile", "h", "seed")


def simplified_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every order's lines as the vertices of one line."""
    line = track(spark, d).select("track_id", "seq", F.col("measure").alias("x"), (F.coalesce("elevation", F.lit(0.0)) / 1000).alias("z"))
    return graphs.simplified(line, "track_id", "seq", 10.0)


QUERIES = {f.__name__: f for f in (cell_maxima, local_maxima, boundary_cells, neighbour_majority, median_smoothing, overlay_paint, scanline_cells, chunk_split, bilinear_samples, connected_components, network_summary, greedy_spacing, continuity_choice, seeded_watershed, simplified_lines)}

_PTS = "(SELECT vec_id, CAST(floor(CAST(embedding[1] AS DOUBLE)*1000) AS BIGINT) AS x, CAST(floor(CAST(embedding[2] AS DOUBLE)*1000) AS BIGINT) AS z, label AS kind FROM embeddings)"
_CELLS = f"(SELECT CAST(floor(x / 8) AS BIGINT) AS x, CAST(floor(z / 8) AS BIGINT) AS z, max(kind::DOUBLE) AS h FROM {_PTS} GROUP BY 1, 2)"
_NEAR = "abs(a.x-b.x) <= 1 AND abs(a.z-b.z) <= 1 AND (a.x <> b.x OR a.z <> b.z)"
_LINKS = "(SELECT o_custkey AS a, o_orderkey % 700 + 100000 AS b FROM orders)"
_ROOTS = f"""WITH RECURSIVE e AS (SELECT a, b FROM {_LINKS} UNION SELECT b, a FROM {_LINKS}), r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)"""

ORACLE_SQL = {
    "cell_maxima": f"SELECT CAST(floor(x / 8.0 + 0.5) AS BIGINT) AS x, CAST(floor(z / 8.0 + 0.5) AS BIGINT) AS z, max(kind::DOUBLE) AS kind, arg_max(vec_id, (kind, -vec_id)) AS vec_id FROM {_PTS} GROUP BY 1, 2",
    "local_maxima": f"SELECT * FROM {_CELLS} a WHERE h >= 2 AND NOT EXISTS (SELECT 1 FROM {_CELLS} b WHERE {_NEAR} AND (b.h > a.h OR (b.h = a.h AND (b.z < a.z OR (b.z = a.z AND b.x < a.x)))))",
    "boundary_cells": f"SELECT x, z FROM {_CELLS} a WHERE (SELECT count(*) FROM {_CELLS} b WHERE abs(a.x-b.x) + abs(a.z-b.z) = 1) < 4",
    "neighbour_majority": f"""
WITH o AS (SELECT * FROM (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) v(dx, dz)),
n AS (SELECT x + dx AS x, z + dz AS z, count(*) AS n FROM {_CELLS}, o GROUP BY 1, 2)
SELECT x, z FROM (SELECT coalesce(c.x, n.x) AS x, coalesce(c.z, n.z) AS z, c.h IS NOT NULL AS own, coalesce(n.n, 0) AS n FROM {_CELLS} c FULL JOIN n ON c.x = n.x AND c.z = n.z) WHERE CASE WHEN own THEN n > 1 ELSE n >= 4 END""",
    "median_smoothing": f"SELECT a.x, a.z, CASE WHEN count(*) >= 3 THEN greatest(least(quantile_cont(b.h, 0.5), a.h + 2), a.h - 2) ELSE a.h END AS smoothed FROM {_CELLS} a JOIN {_CELLS} b ON abs(a.x-b.x) <= 1 AND abs(a.z-b.z) <= 1 GROUP BY a.x, a.z, a.h",
    "overlay_paint": f"SELECT CAST(floor(x / 16) AS BIGINT) AS x, CAST(floor(z / 16) AS BIGINT) AS z, arg_max(kind, (kind % 4, vec_id)) AS layer FROM {_PTS} GROUP BY 1, 2",
    "scanline_cells": """
WITH v AS (SELECT n_nationkey AS k, unnest([1,2,3,4]) AS i, unnest([n_nationkey, n_nationkey+12, n_nationkey+5, n_nationkey-6])::DOUBLE AS x, unnest([-3, n_nationkey, n_nationkey+9, n_nationkey/2.0+1])::DOUBLE AS z FROM nation),
e AS (SELECT a.k, a.x AS ax, a.z AS az, b.x AS bx, b.z AS bz FROM v a JOIN v b ON a.k = b.k AND b.i = a.i % 4 + 1 WHERE a.z <> b.z),
c AS (SELECT k, r.z, ax + (r.z + 0.5::DOUBLE - az) * (bx - ax) / (bz - az) AS at, row_number() OVER (PARTITION BY k, r.z ORDER BY ax + (r.z + 0.5::DOUBLE - az) * (bx - ax) / (bz - az)) AS n FROM e, range(-10, 60) r(z) WHERE least(az, bz) <= r.z + 0.5 AND r.z + 0.5 < greatest(az, bz))
SELECT CAST(p.k AS INT) AS n_nationkey, CAST(p.z AS BIGINT) AS z, CAST(ceil(p.at - 0.5) AS BIGINT) AS first, CAST(floor(q.at - 0.5) AS BIGINT) AS last FROM c p JOIN c q ON p.k = q.k AND p.z = q.z AND q.n = p.n + 1 WHERE p.n % 2 = 1 AND ceil(p.at - 0.5) <= floor(q.at - 0.5)""",
    "chunk_split": f"SELECT vec_id, greatest(x, cx*16) AS x1, greatest(z, cz*16) AS z1, least(x+3*kind, cx*16+15) AS x2, least(z+20, cz*16+15) AS z2, cx AS chunk_x, cz AS chunk_z FROM (SELECT *, unnest(range(CAST(floor(x/16) AS BIGINT), CAST(floor((x+3*kind)/16) AS BIGINT)+1)) AS cx FROM (SELECT *, unnest(range(CAST(floor(z/16) AS BIGINT), CAST(floor((z+20)/16) AS BIGINT)+1)) AS cz FROM {_PTS}))",
    "bilinear_samples": f"""
WITH q AS (SELECT vec_id, x/8.0::DOUBLE - 0.5 AS u, z/8.0::DOUBLE - 0.5 AS v FROM {_PTS}),
c AS (SELECT vec_id, floor(u)+dx AS x, floor(v)+dz AS z, (CASE WHEN dx = 1 THEN u-floor(u) ELSE 1-(u-floor(u)) END)*(CASE WHEN dz = 1 THEN v-floor(v) ELSE 1-(v-floor(v)) END) AS w FROM q, (VALUES (0,0),(1,0),(0,1),(1,1)) o(dx, dz))
SELECT q.vec_id, floor(sum(w*h)/sum(CASE WHEN h IS NOT NULL THEN w END)*1000000+0.5)/1000000 AS h FROM q LEFT JOIN (SELECT c.vec_id, w, h FROM c JOIN {_CELLS} k ON k.x = c.x AND k.z = c.z WHERE w > 0) m ON m.vec_id = q.vec_id GROUP BY q.vec_id""",
    "connected_components": f"{_ROOTS} SELECT node, min(root) AS root FROM r GROUP BY 1",
    "network_summary": f"""{_ROOTS}, d AS (SELECT node, count(*) AS n FROM (SELECT DISTINCT a AS node, b FROM {_LINKS} UNION ALL SELECT DISTINCT b, a FROM {_LINKS}) GROUP BY 1)
SELECT 'components' AS measure, count(DISTINCT root) AS n FROM (SELECT min(root) AS root FROM r GROUP BY node) UNION ALL SELECT 'nodes', count(*) FROM d UNION ALL SELECT 'dangling', count(*) FILTER (WHERE n = 1) FROM d UNION ALL SELECT 'edges', CAST(sum(n)/2 AS BIGINT) FROM d""",
}
