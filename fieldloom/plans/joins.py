"""Queries over spatial, identity and integrity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import geometry
from fieldloom.functions.numbers import half_up
from fieldloom.operators import spatial
from fieldloom.operators.closest import as_boxes, nearest_within
from fieldloom.plans.tables import points, read

#: Radius of the nearest-partner relation, and its greatest number of partners.
RELATION_REACH, RELATION_MOST = 60.0, 3


def _kinds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, d).select(F.col("vec_id").alias("id"), "x", "z", "kind")
    return p.filter("kind % 2 = 0"), p.filter("kind % 2 = 1")


def relations_nearest_n(spark: SparkSession, d: str) -> DataFrame:
    even, odd = map(as_boxes, _kinds(spark, d))
    best = nearest_within(even, odd, RELATION_REACH, RELATION_MOST)
    trust = half_up(0.8 * F.greatest(F.lit(0.35), 1 - F.col("distance") / RELATION_REACH), 3)
    return best.select(F.col("l.id").alias("from_id"), F.col("r.id").alias("to_id"), "place", half_up(F.col("distance"), 3).alias("distance"), trust.alias("confidence"))


def nearest_compatible(spark: SparkSession, d: str) -> DataFrame:
    """The best score is that of the nearest of the next kind or of the nearest of all; scores of points on the metre grid tie only at equal distances."""
    even, odd = map(as_boxes, _kinds(spark, d))
    even = even.withColumn("next", F.col("kind") + 1)
    pairs = nearest_within(even, odd, 50.0, 1, {"kind": "next"}).union(nearest_within(even, odd, 50.0, 1))
    score = 1 - F.col("distance") / 50 + F.when(F.col("l.next") == F.col("r.kind"), 1.25).otherwise(0.0)
    pairs = pairs.select(F.col("l.id").alias("node"), F.col("r.id").alias("seen"), half_up(score, 6).alias("score"))
    return spatial.nearest(pairs, "node", [F.desc("score"), F.asc("seen")], 1).select("node", "seen", "score")


def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    box = points(spark, d).select("vec_id", "kind", (F.col("x") - F.col("kind")).alias("min_x"), (F.col("x") + F.col("kind")).alias("max_x"), (F.col("z") - 5).alias("min_z"), (F.col("z") + 5).alias("max_z"))
    met = spatial.boxes_meeting(box.filter("kind % 2 = 0"), box.filter("kind % 2 = 1"), 4.0, 64.0)
    return met.select(F.col("l.vec_id").alias("a"), F.col("r.vec_id").alias("b"))


def box_gaps(spark: SparkSession, d: str) -> DataFrame:
    box = points(spark, d).select("vec_id", F.struct((F.col("x") - 3).cast("double").alias("min_x"), (F.col("x") + 3).cast("double").alias("max_x"), (F.col("z") - 2).cast("double").alias("min_z"), (F.col("z") + 2).cast("double").alias("max_z")).alias("box"))
    site = F.struct(F.lit(-20.0).alias("min_x"), F.lit(20.0).alias("max_x"), F.lit(-10.0).alias("min_z"), F.lit(10.0).alias("max_z"))
    return box.withColumn("site", site).select("vec_id", half_up(geometry.bounds_distance("box", "site"), 4).alias("gap"))


def replace_by_id(spark: SparkSession, d: str) -> DataFrame:
    base = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    changes = read(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"))
    changes = changes.select((F.col("k") + 10000000).alias("id"), F.concat(F.lit("order "), F.col("k").cast("string")).alias("name"), F.when(F.col("k") % 2 == 0, F.col("o_custkey")).alias("replaces"))
    return spatial.replaced(base, changes, "id", "replaces")[0]


def fanout_limit(spark: SparkSession, d: str) -> DataFrame:
    matches = read(spark, d, "lineitem").join(read(spark, d, "part"), F.expr("l_partkey = p_partkey")).select("l_partkey", "l_orderkey", "l_linenumber")
    return spatial.limited_fanout(matches, "l_partkey", 30)


def semantic_point_dedupe(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("vec_id")
    kind = F.get(F.array(*map(F.lit, ("attraction", "path", "amenity", "detail", "building"))), F.pmod(F.floor(n / 2), F.lit(5)).cast("int"))
    name = F.when(F.col("kind") != 3, F.concat(F.when(n % 3 == 0, "Gate ").otherwise("GATE "), F.col("kind").cast("string")))
    p = points(spark, d).select(n.alias("id"), kind.alias("type"), name.alias("name"), "x", "z").withColumnRenamed("type", "kind")
    return spatial.new_places(p.filter("id % 2 = 1"), p.filter("id % 2 = 0"), 10.0).select("id", "name")


def linear_references(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    by = Window.partitionBy("kind").orderBy("vec_id")
    path = p.select("kind", F.col("x").cast("double").alias("ax"), F.col("z").cast("double").alias("az"), F.lead("x").over(by).cast("double").alias("bx"), F.lead("z").over(by).cast("double").alias("bz"), F.row_number().over(by).alias("n"))
    path = path.filter("bx is not null").withColumn("start", (F.col("n") * 1000).cast("double"))
    asked = p.select(F.col("vec_id").alias("id"), "kind", (F.col("x") + 3).alias("x"), (F.col("z") - 2).alias("z"))
    found = spatial.linear_reference(asked, path, ["kind"], 14.0)
    return found.select("id", half_up(F.col("lateral"), 3).alias("side_m"), half_up(F.col("measure"), 3).alias("measure"))


def line_overlaps(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    lines = p.filter("vec_id % 7 = 0").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n"), "x", "z").select("vec_id", "n", (F.col("x") + 4 * F.col("n")).alias("x"), "z")
    return spatial.overlap_decision(lines, p.filter("vec_id % 7 <> 0").select("vec_id", "x", "z"), "vec_id", 20.0).select("vec_id", half_up(F.col("share"), 3).alias("share"), "decision")


def corridor_points(spark: SparkSession, d: str) -> DataFrame:
    even, odd = _kinds(spark, d)
    return spatial.pairs_within(even, odd, 12.0).groupBy(F.col("l.id").alias("id")).agg(F.count("*").alias("n"), F.min("r.id").alias("least"))


def polygon_membership(spark: SparkSession, d: str) -> DataFrame:
    v = lambda x, z: F.struct(x.cast("double").alias("x"), z.cast("double").alias("z"))
    k = F.col("n_nationkey")
    ring = F.array(v(-40 + 3 * k, -30 + k), v(10 + 2 * k, -25 - k), v(30 + k, 20 + k), v(-5 + k, 45 - k), v(-45 + k, 12 + k))
    rings = read(spark, d, "nation").select("n_nationkey", ring.alias("ring"), F.array_min(F.transform(ring, lambda p: p.x)).alias("min_x"), F.array_max(F.transform(ring, lambda p: p.x)).alias("max_x"), F.array_min(F.transform(ring, lambda p: p.z)).alias("min_z"), F.array_max(F.transform(ring, lambda p: p.z)).alias("max_z"))
    p = points(spark, d).select("vec_id", "x", "z", *(F.col(c).alias(f"{m}_{c}") for c in "xz" for m in ("min", "max")))
    met = spatial.boxes_meeting(rings, p, 0.0, 32.0).filter(geometry.in_ring(F.col("r.x"), F.col("r.z"), F.col("l.ring")))
    return met.groupBy("n_nationkey").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


def polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    v = lambda x, z: F.struct(x.cast("double").alias("x"), z.cast("double").alias("z"))
    k = F.col("n_nationkey")
    ring = F.array(v(k, F.lit(0)), v(k + 10, F.lit(0)), v(k + 10, k), v(F.lit(0), k))
    return read(spark, d, "nation").select("n_nationkey", geometry.ring_area(ring).alias("area"), half_up(geometry.line_length(ring), 4).alias("length"))


def application_merge(spark: SparkSession, d: str) -> DataFrame:
    key = F.regexp_replace(F.regexp_replace(F.lower("url"), r"^https?://(www\.|m\.|blog\.)?", ""), r"[?#].*$|/$", "")
    rows = read(spark, d, "pages").select("page_id", "url", key.alias("key"), F.length("html").alias("score"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.max("score").alias("score"), F.max_by("page_id", F.struct("score", -F.col("page_id"))).alias("best"))


def shard_assignment(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", spatial.shard_of(F.col("doc_id"), 20).alias("shard"), F.sha2("text", 256).alias("identity"))


def shard_integrity(spark: SparkSession, d: str) -> DataFrame:
    planned = read(spark, d, "documents").select("doc_id", F.col("doc_id").alias("position"))
    good = planned.filter("doc_id % 41 <> 0").select("doc_id", F.when(F.col("doc_id") % 37 == 0, 19).otherwise(F.col("doc_id") % 20).cast("int").alias("shard"))
    twice = planned.filter("doc_id % 53 = 1 and doc_id % 41 <> 0").select("doc_id", (F.col("doc_id") % 20).cast("int").alias("shard"))
    other = planned.filter("doc_id < 5").select((F.col("doc_id") + 90000000).alias("doc_id"), F.lit(0).alias("shard"))
    return spatial.shard_problems(planned, good.union(twice).union(other), "doc_id", 20)


QUERIES = {f.__name__: f for f in (relations_nearest_n, nearest_compatible, box_overlaps, box_gaps, replace_by_id, fanout_limit, semantic_point_dedupe, linear_references, line_overlaps, corridor_points, polygon_membership, polygon_measures, application_merge, shard_assignment, shard_integrity)}

_PTS = "(SELECT vec_id, CAST(floor(CAST(embedding[1] AS DOUBLE)*1000) AS BIGINT) AS x, CAST(floor(CAST(embedding[2] AS DOUBLE)*1000) AS BIGINT) AS z, label AS kind FROM embeddings)"
_PAIRS = f"(SELECT a.vec_id AS a, b.vec_id AS b, a.kind AS ka, b.kind AS kb, sqrt((a.x-b.x)*(a.x-b.x)+(a.z-b.z)*(a.z-b.z)) AS distance FROM {_PTS} a, {_PTS} b WHERE a.kind % 2 = 0 AND b.kind % 2 = 1)"
ORACLE_SQL = {
    "relations_nearest_n": f"SELECT a AS from_id, b AS to_id, place, floor(distance*1000+0.5)/1000 AS distance, floor(0.8::DOUBLE*greatest(0.35, 1-distance/60)*1000+0.5)/1000 AS confidence FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY distance, b) AS INT) AS place FROM {_PAIRS} WHERE distance <= 60) WHERE place <= 3",
    "nearest_compatible": f"SELECT a AS node, b AS seen, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n FROM (SELECT a, b, floor((1 - distance/50 + CASE WHEN ka + 1 = kb THEN 1.25::DOUBLE ELSE 0 END)*1000000+0.5)/1000000 AS score FROM {_PAIRS} WHERE distance <= 50)) WHERE n = 1",
    "box_overlaps": f"SELECT a.vec_id AS a, b.vec_id AS b FROM {_PTS} a, {_PTS} b WHERE a.kind % 2 = 0 AND b.kind % 2 = 1 AND a.x - a.kind - 4 <= b.x + b.kind AND b.x - b.kind <= a.x + a.kind + 4 AND a.z - 9 <= b.z + 5 AND b.z - 5 <= a.z + 9",
    "box_gaps": f"SELECT vec_id, floor(sqrt(pow(greatest(0.0, x - 3 - 20, -20 - (x + 3)), 2) + pow(greatest(0.0, z - 2 - 10, -10 - (z + 2)), 2))*10000+0.5)/10000 AS gap FROM {_PTS}",
    "replace_by_id": "WITH ch AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM ch WHERE k % 2 = 0) UNION ALL SELECT k + 10000000, 'order ' || k FROM ch",
    "fanout_limit": "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey QUALIFY count(*) OVER (PARTITION BY l_partkey) <= 30",
    "semantic_point_dedupe": f"""
WITH p AS (SELECT vec_id AS id, list_extract(['attraction', 'path', 'amenity', 'detail', 'building'], (vec_id // 2) % 5 + 1) AS kind, CASE WHEN s.kind <> 3 THEN CASE WHEN vec_id % 3 = 0 THEN 'Gate ' ELSE 'GATE ' END || s.kind END AS name, x, z FROM {_PTS} s)
SELECT id, name FROM p a WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.id % 2 = 0 AND b.kind IN ('attraction', 'amenity', 'detail') AND lower(b.name) = lower(a.name) AND (a.x-b.x)*(a.x-b.x)+(a.z-b.z)*(a.z-b.z) <= 1600)""",
    "linear_references": f"""
WITH path AS (SELECT kind, x::DOUBLE AS ax, z::DOUBLE AS az, (lead(x) OVER w)::DOUBLE AS bx, (lead(z) OVER w)::DOUBLE AS bz, row_number() OVER w * 1000.0::DOUBLE AS start FROM {_PTS} WINDOW w AS (PARTITION BY kind ORDER BY vec_id)),
met AS (SELECT p.vec_id AS id, start, p.x + 3 AS px, p.z - 2 AS pz, ax, az, bx-ax AS dx, bz-az AS dz FROM {_PTS} p JOIN path ON path.kind = p.kind WHERE bx IS NOT NULL),
u AS (SELECT *, CASE WHEN dx*dx+dz*dz = 0 THEN 0 ELSE greatest(0.0, least(1.0, ((px-ax)*dx+(pz-az)*dz)/nullif(dx*dx+dz*dz, 0))) END AS t FROM met),
v AS (SELECT id, sqrt(pow(px-(ax+t*dx), 2)+pow(pz-(az+t*dz), 2)) AS side, start+t*sqrt(dx*dx+dz*dz) AS measure FROM u)
SELECT id, floor(side*1000+0.5)/1000 AS side_m, floor(measure*1000+0.5)/1000 AS measure FROM v WHERE side <= 14 QUALIFY row_number() OVER (PARTITION BY id ORDER BY side, measure) = 1""",
    "line_overlaps": f"""
WITH s AS (SELECT vec_id, n, x + 4*n AS x, z FROM {_PTS}, range(10) r(n) WHERE vec_id % 7 = 0),
h AS (SELECT s.vec_id, s.n, max(CASE WHEN (s.x-p.x)*(s.x-p.x)+(s.z-p.z)*(s.z-p.z) <= 400 THEN 1.0::DOUBLE ELSE 0 END) AS hit FROM s, {_PTS} p WHERE p.vec_id % 7 <> 0 GROUP BY 1, 2),
q AS (SELECT vec_id, sum(hit)/count(*) AS share FROM h GROUP BY 1)
SELECT vec_id, floor(share*1000+0.5)/1000 AS share, CASE WHEN share >= 0.8 THEN 'duplicate' WHEN share >= 0.2 THEN 'partial' ELSE 'accept' END AS decision FROM q""",
    "corridor_points": f"SELECT a AS id, count(*) AS n, min(b) AS least FROM {_PAIRS} WHERE distance <= 12 GROUP BY 1",
    "polygon_membership": f"""
WITH v AS (SELECT n_nationkey AS k, unnest([1,2,3,4,5]) AS i, unnest([-40+3*n_nationkey, 10+2*n_nationkey, 30+n_nationkey, -5+n_nationkey, -45+n_nationkey])::DOUBLE AS x, unnest([-30+n_nationkey, -25-n_nationkey, 20+n_nationkey, 45-n_nationkey, 12+n_nationkey])::DOUBLE AS z FROM nation),
e AS (SELECT a.k, a.x AS ax, a.z AS az, b.x AS bx, b.z AS bz FROM v a JOIN v b ON a.k = b.k AND b.i = a.i % 5 + 1),
c AS (SELECT k, vec_id, count(*) FILTER (WHERE (az > p.z) <> (bz > p.z) AND p.x < (bx-ax)*(p.z-az)/nullif(bz-az, 0)+ax) AS n FROM e, {_PTS} p GROUP BY 1, 2)
SELECT CAST(k AS INT) AS n_nationkey, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM c WHERE n % 2 = 1 GROUP BY 1""",
    "polygon_measures": "SELECT n_nationkey, (0.0::DOUBLE + (n_nationkey+10)*n_nationkey + ((n_nationkey+10)*n_nationkey) - n_nationkey*n_nationkey)/2 AS area, floor((10 + n_nationkey + n_nationkey + 10)*10000.0+0.5)/10000 AS length FROM nation",
    "application_merge": r"""
WITH r AS (SELECT page_id, length(html) AS score, regexp_replace(regexp_replace(lower(url), '^https?://(www\.|m\.|blog\.)?', ''), '[?#].*$|/$', '', 'g') AS key FROM pages)
SELECT key, count(*) AS n, CAST(max(score) AS INT) AS score, arg_max(page_id, (score, -page_id)) AS best FROM r GROUP BY 1""",
    "shard_assignment": "SELECT doc_id, CAST(doc_id % 20 AS INT) AS shard, sha256(text) AS identity FROM documents",
    "shard_integrity": """
SELECT 'missing' AS problem, doc_id FROM documents WHERE doc_id % 41 = 0
UNION ALL SELECT 'misplaced', doc_id FROM documents WHERE doc_id % 41 <> 0 AND doc_id % 37 = 0 AND doc_id % 20 <> 19
UNION ALL SELECT 'repeated', doc_id FROM documents WHERE doc_id % 53 = 1 AND doc_id % 41 <> 0
UNION ALL SELECT 'unplanned', doc_id + 90000000 FROM documents WHERE doc_id < 5""",
}
