"""Queries over surfaces, stands and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.numbers import half_up
from fieldloom.operators import surfaces, trees
from fieldloom.plans.columns import _lab_sql
from fieldloom.plans.made import Made
from fieldloom.plans.tables import read

RIDE = Made(
    "p_partkey",
    {"elevation": [3.5, None, 110.0], "explicit": [True, None, False, True], "source": [None, "survey", "DTM sample", "Terrain"], "subtype": ["Scree", "grass", None, "rock"], "dx": [0.0, 3.0, -7.5], "dy": [0.0, 2.0, -4.0, 9.0], "dz": [1.0, 5.0], "radius": [6.0, 8.0, 2.0], "above": [3.0, 9.0], "below": [4.0, 1.0]},
)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    k, wide = F.col("l_suppkey"), F.col("l_suppkey") % 5 + 1
    near = lambda n, m: (F.pmod(k * n, F.lit(200)) + F.pmod(F.col("l_partkey") * m, wide * 8)).cast("double")
    return read(spark, d, "lineitem").select("l_suppkey", near(7, 1).alias("r"), near(7, 3).alias("g"), F.when(k % 2 == 0, near(7, 5)).otherwise(near(5, 5)).alias("b"), F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).alias("prototype"))


def sampled_materials(spark: SparkSession, d: str) -> DataFrame:
    got = surfaces.material(surfaces.with_texture(_samples(spark, d), "l_suppkey"), 0.25)
    return got.select("l_suppkey", "n", "r", "g", "b", half_up(F.col("texture"), 6).alias("texture"), "material", "trust", "pattern")


def aerial_patches(spark: SparkSession, d: str) -> DataFrame:
    byte = lambda c, n: F.pmod(F.col(c) * n, F.lit(256)).cast("double")
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", byte("l_partkey", 13).alias("r"), byte("l_suppkey", 29).alias("g"), byte("l_orderkey", 7).alias("b"), (F.col("l_quantity") / 2).alias("texture"))
    return surfaces.patch(rows).select("l_orderkey", "l_linenumber", "class", "trust")


def component_appearance(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.appearance(_samples(spark, d), "l_suppkey", "prototype")


def vegetation_models(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey")
    words = F.get(F.array(F.lit("Woodland"), F.lit("tree"), F.lit(None).cast("string"), F.lit("hedge")), F.pmod(k, F.lit(4)).cast("int"))
    rows = read(spark, d, "lineitem").select(
        "l_partkey", F.when(k % 7 != 0, F.col("l_quantity")).alias("ground"), F.when(k % 5 != 0, F.col("l_quantity") + F.col("l_extendedprice") / 10000).alias("surface"),
        F.when(k % 3 == 0, (k % 20).cast("double")).alias("stated"), F.when(k % 11 != 0, (k % 400).cast("double")).alias("area"), words.alias("words"),
    )
    return surfaces.vegetation(rows, ["l_partkey"])


def species_distribution(spark: SparkSession, d: str) -> DataFrame:
    name = F.get(F.array(*(F.lit(x) for x in ("oak", "ash", "", "yew", "elm"))), F.pmod(F.col("l_partkey"), F.lit(5)).cast("int"))
    return surfaces.species_shares(read(spark, d, "lineitem").select("l_suppkey", name.alias("species"), (F.col("l_quantity") - 5).alias("weight")), "l_suppkey")


def ride_summaries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    rows = read(spark, d, "lineitem").select(
        F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit("ride "), (k % 50).cast("string"))).alias("ride"), k.cast("string").alias("id"), F.when((F.col("l_linenumber") % 4 != 0) & (k % 6 != 0), F.col("l_quantity")).alias("elevation"),
        (F.floor(F.col("l_discount") * 100 + 0.5) / 128).alias("trust"), F.col("l_returnflag").alias("method"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
    )
    return surfaces.ride_summary(rows)


def chunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = F.col("l_suppkey") * 3 - 500, F.col("l_linenumber") - 9, F.pmod(F.col("l_partkey"), F.lit(900)) - 450
    rows = read(spark, d, "lineitem").select("l_returnflag", x.alias("x0"), (x + 9).alias("x1"), y.alias("y0"), (y + 5).alias("y1"), z.alias("z0"), (z + 2).alias("z1"))
    return surfaces.chunk_bounds(rows, ["l_returnflag"], 24)


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = read(spark, d, "part").select("p_partkey", *RIDE.columns())
    crown = trees.crown_geometry(c("radius"), c("above"), c("below"), c("radius"), F.lit(1.0), F.lit(None).cast("double"), F.lit(2.0), F.lit(10.0))
    return rows.select(
        "p_partkey", surfaces.ride_elevation(c("elevation"), c("explicit"), c("source")).alias("elevation"), surfaces.rock_surface(c("subtype")).alias("rock"),
        surfaces.in_envelope(c("dx"), c("dy"), c("dz"), c("radius"), c("above"), c("below")).alias("near_ride"), surfaces.in_crown(c("dx"), c("dz"), crown).alias("in_crown"),
    )


QUERIES = {f.__name__: f for f in (sampled_materials, aerial_patches, component_appearance, vegetation_models, species_distribution, ride_summaries, chunk_ranges, envelopes)}

_r = lambda x, n=3: f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"
_near = lambda n, m: f"CAST((l_suppkey * {n}) % 200 + (l_partkey * {m}) % ((l_suppkey % 5 + 1) * 8) AS DOUBLE)"
_SAMPLES = f"(SELECT l_suppkey, {_near(7, 1)} AS r, {_near(7, 3)} AS g, CASE WHEN l_suppkey % 2 = 0 THEN {_near(7, 5)} ELSE {_near(5, 5)} END AS b, CASE WHEN l_linenumber < 6 THEN l_linenumber END AS prototype FROM lineitem)"
_tone = "CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END"
_lin = lambda c: f"CASE WHEN {c} / 255 <= 0.04045 THEN {c} / 255 / 12.92::DOUBLE ELSE pow(({c} / 255 + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
ORACLE_SQL = {
    "sampled_materials": f"""
WITH s AS {_SAMPLES}, m AS (SELECT l_suppkey, count(*) AS n, median(r) AS r, median(g) AS g, median(b) AS b FROM s GROUP BY 1),
a AS ({_lab_sql().format(src='s')}), c AS ({_lab_sql().format(src='m')}),
t AS (SELECT c.l_suppkey, c.n, c.r, c.g, c.b, c.cl AS light, avg(sqrt(pow(a.cl - c.cl, 2) + pow(a.ca - c.ca, 2) + pow(a.cb - c.cb, 2))) AS texture FROM a JOIN c USING (l_suppkey) GROUP BY ALL),
k AS (SELECT *, {_tone} AS tone FROM t),
v AS (SELECT *, CASE WHEN tone < 0.2 AND light < 52 AND texture < 14 THEN 'asphalt' WHEN tone < 0.18 AND light >= 52 AND light < 86 AND texture < 12 THEN 'concrete' WHEN tone < 0.24 AND texture > 18 THEN 'gravel'
 WHEN r > g * 1.13::DOUBLE AND g > b * 1.12::DOUBLE AND tone BETWEEN 0.18 AND 0.62 AND light BETWEEN 28 AND 68 THEN 'earth' WHEN r > g * 1.15::DOUBLE AND g > b * 1.05::DOUBLE THEN 'paving_stones' END AS x FROM k)
SELECT l_suppkey, n, r, g, b, {_r('texture', 6)} AS texture, CASE WHEN n >= 8 THEN x END AS material, CASE WHEN n >= 8 THEN {_r('''CASE x WHEN 'asphalt' THEN greatest(0.68::DOUBLE, least(0.92::DOUBLE, 0.86::DOUBLE - texture / 180)) WHEN 'concrete' THEN greatest(0.67::DOUBLE, least(0.9::DOUBLE, 0.845::DOUBLE - texture / 180)) WHEN 'gravel' THEN 0.74::DOUBLE
 WHEN 'earth' THEN greatest(0.68::DOUBLE, least(0.88::DOUBLE, 0.7525::DOUBLE + greatest(0, least(1, 1 - abs(texture - 10) / 18)) * 0.12::DOUBLE)) WHEN 'paving_stones' THEN 0.7::DOUBLE ELSE 0 END''')} END AS trust, CASE WHEN n >= 8 AND texture < 7 THEN 'solid' END AS pattern FROM v""",
    "aerial_patches": f"""
WITH p AS (SELECT l_orderkey, l_linenumber, CAST((l_partkey * 13) % 256 AS DOUBLE) AS r, CAST((l_suppkey * 29) % 256 AS DOUBLE) AS g, CAST((l_orderkey * 7) % 256 AS DOUBLE) AS b, l_quantity / 2 AS texture FROM lineitem),
i AS (SELECT *, 0.2126::DOUBLE * {_lin('r')} + 0.7152::DOUBLE * {_lin('g')} + 0.0722::DOUBLE * {_lin('b')} AS light, {_tone} AS tone, (g - (r + b) / 2) / 255 AS green, (b - (r + g) / 2) / 255 AS blue, (r - b) / 255 AS warm, (least(r, g) - b) / 255 AS dry FROM p),
c AS (SELECT *, CASE WHEN light < 0.045 THEN 'shadow' WHEN blue > 0.1 AND b > 55 AND light < 0.58 THEN 'water-candidate' WHEN green > 0.075 AND g > 48 THEN CASE WHEN texture >= 8 OR light < 0.34 OR tone > 0.42 THEN 'dense-tree-canopy' WHEN light > 0.42 THEN 'grass' ELSE 'vegetation' END
 WHEN r > g * 1.06::DOUBLE AND g > b * 1.04::DOUBLE AND warm > 0.08 AND light BETWEEN 0.12 AND 0.62 THEN 'soil-mulch' WHEN dry > 0.08 AND warm > 0.04 AND light > 0.24 AND g >= r * 0.84::DOUBLE THEN 'dry-grass' WHEN tone < 0.2 AND texture >= 8 AND light BETWEEN 0.16 AND 0.72 THEN 'rock-gravel'
 WHEN warm > 0.03 AND tone < 0.28 AND light > 0.62 THEN 'sand' WHEN tone < 0.2 AND light > 0.08 AND light < 0.84 THEN 'neutral-hardscape-candidate' ELSE 'unclassified' END AS class FROM i)
SELECT l_orderkey, l_linenumber, class, {_r('''greatest(0, least(0.99::DOUBLE, CASE class WHEN 'shadow' THEN 0.88::DOUBLE WHEN 'water-candidate' THEN 0.64::DOUBLE + blue * 1.6::DOUBLE WHEN 'dense-tree-canopy' THEN 0.72::DOUBLE + green * 1.45::DOUBLE + least(0.12::DOUBLE, texture / 120) WHEN 'grass' THEN 0.7::DOUBLE + green * 1.35::DOUBLE WHEN 'vegetation' THEN 0.7::DOUBLE + green * 1.35::DOUBLE
 WHEN 'soil-mulch' THEN 0.69::DOUBLE + least(0.14::DOUBLE, warm * 0.7::DOUBLE) + least(0.08::DOUBLE, texture / 160) WHEN 'dry-grass' THEN 0.67::DOUBLE + dry * 1.2::DOUBLE WHEN 'rock-gravel' THEN 0.66::DOUBLE + least(0.16::DOUBLE, texture / 100) WHEN 'sand' THEN 0.66::DOUBLE + least(0.16::DOUBLE, light * 0.16::DOUBLE) WHEN 'neutral-hardscape-candidate' THEN 0.68::DOUBLE - tone * 0.5::DOUBLE ELSE 0.35::DOUBLE END))''')} AS trust FROM c""",
    "component_appearance": f"""
WITH s AS {_SAMPLES}, c AS (SELECT l_suppkey, prototype, count(*) AS n FROM s WHERE prototype IS NOT NULL GROUP BY 1, 2), b AS (SELECT l_suppkey, prototype FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, prototype) = 1)
SELECT m.l_suppkey, r, g, b, prototype FROM (SELECT l_suppkey, CAST(floor(median(r) + 0.5) AS BIGINT) AS r, CAST(floor(median(g) + 0.5) AS BIGINT) AS g, CAST(floor(median(b) + 0.5) AS BIGINT) AS b FROM s GROUP BY 1) m LEFT JOIN b ON b.l_suppkey = m.l_suppkey""",
    "vegetation_models": f"""
WITH s AS (SELECT l_partkey AS k, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS g, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity + l_extendedprice / 10000 END AS s FROM lineitem),
m AS (SELECT k, median(g) AS ground, quantile_cont(s, 0.9) AS seen, CASE WHEN k % 3 = 0 THEN (k % 20)::DOUBLE END AS stated, CASE WHEN k % 11 <> 0 THEN (k % 400)::DOUBLE END AS area, k % 4 AS w FROM s GROUP BY k),
c AS (SELECT *, coalesce(seen, ground + stated) AS canopy FROM m), h AS (SELECT *, coalesce(stated, CASE WHEN canopy IS NOT NULL AND ground IS NOT NULL THEN greatest(0, canopy - ground) END) AS height FROM c)
SELECT k AS l_partkey, CASE WHEN ground IS NOT NULL AND canopy IS NOT NULL AND height IS NOT NULL THEN 'resolved' WHEN coalesce(ground, canopy, area) IS NOT NULL THEN 'partial' ELSE 'unresolved' END AS status,
 CASE WHEN w = 0 THEN 'woodland' WHEN coalesce(area <= 180, false) AND (w = 1 OR coalesce(height, 0) >= 3) THEN 'individual-tree' ELSE 'canopy-group' END AS class, {_r('ground')} AS ground, {_r('canopy')} AS canopy, {_r('height')} AS height, CASE WHEN area > 0 THEN {_r('2 * sqrt(area / pi())')} END AS diameter, {_r('area * height * 0.55::DOUBLE')} AS volume FROM h""",
    "species_distribution": f"""
WITH e AS (SELECT l_suppkey, list_extract(['oak', 'ash', '', 'yew', 'elm'], l_partkey % 5 + 1) AS species, sum(l_quantity - 5) AS w FROM lineitem WHERE l_quantity > 5 AND l_partkey % 5 <> 2 GROUP BY 1, 2),
p AS (SELECT *, w / sum(w) OVER (PARTITION BY l_suppkey) AS share, count(*) OVER (PARTITION BY l_suppkey) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, species) AS place FROM e)
SELECT l_suppkey, species, CAST(place AS INT) AS place, {_r('share', 6)} AS share, CASE WHEN place = 1 THEN {_r('least(0.93::DOUBLE, 0.52::DOUBLE + share * 0.28::DOUBLE + least(1.0, n / 4) * 0.12::DOUBLE)')} END AS trust FROM p""",
    "ride_summaries": f"""
WITH s AS (SELECT CASE WHEN l_orderkey % 3 = 1 THEN 'ride ' || l_orderkey % 50 ELSE l_orderkey::VARCHAR END AS ride, CASE WHEN l_linenumber % 4 <> 0 AND l_orderkey % 6 <> 0 THEN l_quantity END AS e, floor(l_discount * 100 + 0.5) / 128 AS t, l_returnflag AS m, strftime(l_shipdate, '%Y-%m-%d') AS d FROM lineitem),
g AS (SELECT ride, count(*) AS samples, count(e) AS seen, coalesce(sum(CASE WHEN e IS NOT NULL THEN t END) / nullif(count(e), 0), 0) AS trust, min(e) AS low, max(e) AS high, array_to_string(list_sort(list(DISTINCT m)), ',') AS methods, max(d) AS newest FROM s GROUP BY 1)
SELECT ride, samples, {_r('seen / samples')} AS coverage, {_r('trust')} AS trust, low, high, methods, newest, CASE WHEN seen = samples THEN 'full' WHEN seen > 0 THEN 'partial' ELSE 'plan-only' END AS status FROM g""",
    "chunk_ranges": """
WITH o AS (SELECT l_returnflag, l_suppkey * 3 - 500 AS x, l_linenumber - 9 AS y, l_partkey % 900 - 450 AS z FROM lineitem),
g AS (SELECT l_returnflag, CAST(floor((min(x) - 24) / 16) AS BIGINT) AS min_cx, CAST(floor((max(x) + 33) / 16) AS BIGINT) AS max_cx, CAST(floor((min(z) - 24) / 16) AS BIGINT) AS min_cz, CAST(floor((max(z) + 26) / 16) AS BIGINT) AS max_cz, least(0, min(y)) AS low, greatest(0, max(y) + 5) AS high FROM o GROUP BY 1)
SELECT *, (max_cx - min_cx + 1) * (max_cz - min_cz + 1) AS chunks FROM g""",
    "envelopes": f"""
WITH e AS (SELECT p_partkey, {RIDE.sql()} FROM part)
SELECT p_partkey, CASE WHEN coalesce(explicit, false) AND coalesce(source, '') NOT IN ('DTM sample', 'Terrain') THEN elevation END AS elevation, coalesce(subtype IN ('Scree', 'rock'), false) AS rock,
 (dx * dx + dz * dz) / pow(radius + 0.5, 2) + dy * dy / pow(CASE WHEN dy >= 0 THEN above ELSE below END + 0.5, 2) <= 1 AS near_ride,
 pow((dx - (above - radius) / 2) / greatest(0.5, (radius + above) / 2), 2) + pow((dz - (radius - below) / 2) / greatest(0.5, (below + radius) / 2), 2) <= 1.12 AS in_crown FROM e""",
}
