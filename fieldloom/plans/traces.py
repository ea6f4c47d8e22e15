"""Queries that trace skeletons, outlines and crowns over the cells of all points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.numbers import half_up
from fieldloom.operators import canopy, tracing
from fieldloom.plans.tables import points


def _cells(spark: SparkSession, d: str, width: int) -> DataFrame:
    p = points(spark, d).select(F.floor(F.col("x") / width).cast("bigint").alias("x"), F.floor(F.col("z") / width).cast("bigint").alias("z"), "kind")
    return p.groupBy("x", "z").agg(F.max("kind").alias("kind"))


def skeleton_edges(spark: SparkSession, d: str) -> DataFrame:
    """Cells of four metres; those of the highest kinds are mapped routes."""
    cells = _cells(spark, d, 8)
    found = tracing.classified(tracing.traced(cells), cells.filter("kind >= 9"), size=4.0, buffer=8.0)
    return found.withColumns({"length": half_up(F.col("length"), 6), "novel": half_up(F.col("novel"), 6)})


def region_rings(spark: SparkSession, d: str) -> DataFrame:
    return tracing.rings(_cells(spark, d, 12), 0.5, 10.0, -4.0).drop("region")


def tree_crowns(spark: SparkSession, d: str) -> DataFrame:
    """Every point is a sample of the canopy and, moved a little, a tree."""
    p = points(spark, d).withColumns({"x": F.col("x") / 8, "z": F.col("z") / 8})
    samples = p.select("x", "z", F.col("kind").cast("double").alias("canopy"), F.when(F.pmod("kind", F.lit(3)) == 0, F.col("kind") / 4).alias("base"))
    trees = p.select(F.col("vec_id").alias("tree_id"), (F.col("x") + 0.375).alias("x"), (F.col("z") - 0.25).alias("z"))
    return canopy.crowns(trees, samples)


QUERIES = {f.__name__: f for f in (skeleton_edges, region_rings, tree_crowns)}

_PTS = "(SELECT vec_id, CAST(floor(CAST(embedding[1] AS DOUBLE)*1000) AS BIGINT) AS x, CAST(floor(CAST(embedding[2] AS DOUBLE)*1000) AS BIGINT) AS z, label AS kind FROM embeddings)"
_NEAR = "abs(a.x - b.x) <= 1 AND abs(a.z - b.z) <= 1 AND (a.x <> b.x OR a.z <> b.z)"
_OF = lambda width: f"(SELECT CAST(floor(x / {width}) AS BIGINT) AS x, CAST(floor(z / {width}) AS BIGINT) AS z, max(kind) AS kind FROM {_PTS} GROUP BY 1, 2)"
ORACLE_SQL = {
    "skeleton_edges": f"""
WITH RECURSIVE c AS {_OF(8)},
p AS (SELECT a.x AS ax, a.z AS az, b.x AS bx, b.z AS bz FROM c a JOIN c b ON {_NEAR}),
d AS (SELECT ax AS x, az AS z, count(*) AS n FROM p GROUP BY 1, 2),
w(sx, sz, tx, tz, px, pz, x, z, seq) AS (
  SELECT ax, az, bx, bz, ax, az, bx, bz, 1 FROM p JOIN d ON d.x = ax AND d.z = az WHERE n <> 2
  UNION ALL
  SELECT w.sx, w.sz, w.tx, w.tz, w.x, w.z, p.bx, p.bz, seq + 1 FROM w JOIN d ON d.x = w.x AND d.z = w.z AND d.n = 2 JOIN p ON p.ax = w.x AND p.az = w.z WHERE (p.bx <> w.px OR p.bz <> w.pz)),
o(sx, sz, tx, tz, px, pz, x, z, seq) AS (
  SELECT ax, az, bx, bz, ax, az, bx, bz, 1 FROM p JOIN d ON d.x = ax AND d.z = az WHERE n = 2 AND NOT EXISTS (SELECT 1 FROM w WHERE w.x = ax AND w.z = az)
  UNION ALL
  SELECT o.sx, o.sz, o.tx, o.tz, o.x, o.z, p.bx, p.bz, seq + 1 FROM o JOIN p ON p.ax = o.x AND p.az = o.z WHERE (p.bx <> o.px OR p.bz <> o.pz) AND (o.x <> o.sx OR o.z <> o.sz)),
s AS (SELECT * FROM w UNION ALL SELECT * FROM o WHERE (sx, sz, tx, tz) IN (SELECT (sx, sz, tx, tz) FROM o GROUP BY sx, sz, tx, tz HAVING min((z, x)) = (sz, sx))),
near AS (SELECT DISTINCT c.x + i.dx AS x, c.z + j.dz AS z FROM c, range(-2, 3) i(dx), range(-2, 3) j(dz) WHERE c.kind >= 9 AND dx * dx + dz * dz <= 4),
q AS (SELECT sx, sz, tx, tz, 0 AS seq, sx AS x, sz AS z, NULL::DOUBLE AS run, NULL::BIGINT AS px, NULL::BIGINT AS pz FROM s WHERE seq = 1 UNION ALL SELECT sx, sz, tx, tz, seq, x, z, CASE WHEN x = px OR z = pz THEN 1 ELSE sqrt(2.0::DOUBLE) END, px, pz FROM s),
e AS (
  SELECT sx AS x1, sz AS z1, tx, tz, arg_max(q.x, seq) AS x2, arg_max(q.z, seq) AS z2, arg_max(px, seq) AS bx, arg_max(pz, seq) AS bz, count(*) AS n_cells, sum(run) * 4 AS length,
    count(*) FILTER (n.x IS NULL) / count(*) AS novel, arg_min(n.x IS NOT NULL, seq) AS start_anchored, arg_max(n.x IS NOT NULL, seq) AS end_anchored
  FROM q LEFT JOIN near n ON n.x = q.x AND n.z = q.z GROUP BY sx, sz, tx, tz)
SELECT x1, z1, x2, z2, n_cells, floor(novel * 1000000 + 0.5) / 1000000 AS novel, start_anchored, end_anchored, floor(length * 1000000 + 0.5) / 1000000 AS length,
  CASE WHEN start_anchored AND end_anchored THEN 'connector' WHEN start_anchored OR end_anchored THEN 'extension' ELSE 'image-visible-branch' END AS classification, novel < 0.35 AS overlaps
FROM e WHERE (z1, x1, tz - z1, tx - x1) <= (z2, x2, bz - z2, bx - x2) AND length >= 5 AND novel >= 0.2""",
    "region_rings": f"""
WITH RECURSIVE c AS {_OF(12)},
r(x, z, rx, rz) AS (SELECT x, z, x, z FROM c UNION SELECT c.x, c.z, r.rx, r.rz FROM r JOIN c ON abs(c.x - r.x) + abs(c.z - r.z) = 1),
l AS (SELECT x, z, min((rz, rx)) AS region FROM r GROUP BY 1, 2),
sides AS (SELECT * FROM (VALUES (0, 0, 0, 1, 0, 0, -1), (1, 1, 0, 1, 1, 1, 0), (2, 1, 1, 0, 1, 0, 1), (3, 0, 1, 0, 0, -1, 0)) v(side, bx, bz, ex, ez, nx, nz)),
e AS (SELECT c.x, c.z, side, c.x + bx AS x1, c.z + bz AS z1, c.x + ex AS x2, c.z + ez AS z2 FROM c, sides WHERE NOT EXISTS (SELECT 1 FROM c n WHERE n.x = c.x + nx AND n.z = c.z + nz)),
step AS (SELECT a.x, a.z, a.side, arg_max({{'x': b.x, 'z': b.z, 'side': b.side}}, a.x = b.x AND a.z = b.z) AS to FROM e a JOIN e b ON a.x2 = b.x1 AND a.z2 = b.z1 GROUP BY a.x, a.z, a.side),
w(sx, sz, s, x, z, side, seq) AS (
  SELECT x, z, side, x, z, side, 0 FROM e
  UNION ALL SELECT sx, sz, s, t.to.x, t.to.z, t.to.side, seq + 1 FROM w JOIN step t ON t.x = w.x AND t.z = w.z AND t.side = w.side WHERE NOT (t.to.x = sx AND t.to.z = sz AND t.to.side = s)),
head AS (SELECT sx, sz, s FROM w JOIN e USING (x, z, side) GROUP BY sx, sz, s HAVING arg_min((sx, sz, s), (z1, x1, side)) = arg_min((x, z, side), (z1, x1, side))),
ring AS (
  SELECT w.*, e.x1, e.z1, lag(w.side) OVER o AS before, last_value(w.side) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, sum(x1 * z2 - x2 * z1) OVER (PARTITION BY sx, sz, s) / 2 AS cells
  FROM w JOIN head USING (sx, sz, s) JOIN e USING (x, z, side) WINDOW o AS (PARTITION BY sx, sz, s ORDER BY seq)),
numbered AS (SELECT sx, sz, s, row_number() OVER (PARTITION BY region ORDER BY cells < 0, abs(cells) DESC, z1, x1, s) - 1 AS ring FROM ring JOIN l ON l.x = sx AND l.z = sz WHERE seq = 0)
SELECT CAST(ring AS INT) AS ring, CAST(seq AS BIGINT) AS seq, 10.0::DOUBLE + x1 * 0.5::DOUBLE AS x, -4.0::DOUBLE + z1 * 0.5::DOUBLE AS z, CAST(cells * 0.25 AS DOUBLE) AS area FROM ring JOIN numbered USING (sx, sz, s) WHERE side <> coalesce(before, last)""",
    "tree_crowns": f"""
WITH RECURSIVE p AS (SELECT vec_id, x / 8.0::DOUBLE AS x, z / 8.0::DOUBLE AS z, kind FROM {_PTS}),
k AS (SELECT CAST(floor(x + 0.5::DOUBLE) AS BIGINT) AS gx, CAST(floor(z + 0.5::DOUBLE) AS BIGINT) AS gz, arg_max({{'x': p.x, 'z': p.z, 'c': p.kind, 'b': CASE WHEN p.kind % 3 = 0 THEN p.kind / 4.0::DOUBLE END}}, (p.kind, -p.z, -p.x)) AS s FROM p WHERE kind >= 2 GROUP BY 1, 2),
c AS (SELECT gx, gz, s.x AS x, s.z AS z, s.c AS canopy, s.b AS base FROM k),
r(x, z, rx, rz) AS (SELECT gx, gz, gx, gz FROM c UNION SELECT c.gx, c.gz, r.rx, r.rz FROM r JOIN c ON abs(c.gx - r.x) <= 1 AND abs(c.gz - r.z) <= 1),
l AS (SELECT x AS gx, z AS gz, min((rz, rx)) AS region FROM r GROUP BY 1, 2),
seeds AS (
  SELECT t.vec_id AS tree_id, t.x + 0.375 AS tx, t.z - 0.25 AS tz, arg_min({{'x': c.gx, 'z': c.gz}}, (sqrt(pow(c.x - t.x - 0.375, 2) + pow(c.z - t.z + 0.25, 2)), c.z, c.x)) AS g FROM p t JOIN c ON abs(c.x - t.x - 0.375) <= 3 AND abs(c.z - t.z + 0.25) <= 3
  WHERE sqrt(pow(c.x - t.x - 0.375, 2) + pow(c.z - t.z + 0.25, 2)) <= 3 GROUP BY 1, 2, 3),
shapes AS (SELECT region, min(x) - 0.5 AS x1, max(x) + 0.5 AS x2, min(z) - 0.5 AS z1, max(z) + 0.5 AS z2, max(canopy)::DOUBLE AS max_canopy, quantile_cont(base, 0.25) AS crown_base, count(*) AS cells FROM c JOIN l USING (gx, gz) GROUP BY region),
m AS (
  SELECT tree_id, s.*, count(*) OVER (PARTITION BY region) AS shared, greatest(0.5, tx - x1) AS west, greatest(0.5, x2 - tx) AS east, greatest(0.5, tz - z1) AS north, greatest(0.5, z2 - tz) AS south
  FROM seeds JOIN l ON l.gx = g.x AND l.gz = g.z JOIN shapes s USING (region)),
f AS (SELECT *, (east + west) / 2 AS radius_x, (north + south) / 2 AS radius_z, (east - west) / 2 AS offset_x, (south - north) / 2 AS offset_z FROM m)
SELECT tree_id, {", ".join(f"floor({v} * 1000 + 0.5) / 1000 AS {v}" for v in ("west", "east", "north", "south", "radius_x", "radius_z", "offset_x", "offset_z", "max_canopy", "crown_base"))},
  floor(least(1, sqrt(offset_x * offset_x + offset_z * offset_z) / greatest(0.5, radius_x, radius_z)) * 1000 + 0.5) / 1000 AS asymmetry, cells::DOUBLE AS area, cells, shared FROM f""",
}
