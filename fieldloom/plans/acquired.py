"""Queries over acquired sources and surface shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import acquisition
from fieldloom.plans.made import Made
from fieldloom.plans.tables import points, read

STYLE = Made("p_partkey", {"pattern": ["Stack bond", None, "herringbone", "Random", "unheard", "running-bond"], "material": ["brick", "gravel", None, "asphalt", "wood", "paving_stones", "sett"], "turn": ["45", None, "-100 deg", "271.5", "x", "720"], "block": ["minecraft:red_terracotta", "minecraft:dark_oak_planks", "minecraft:stone", "minecraft:cut_sandstone", "minecraft:oak_log", None], "shape": ["Slab", "stairs", None, "WALL", "fence", "trap door", "trapdoor"], "direction": ["north", "3", None, "7", "East"]})


def place_ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").select("c_nationkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 9 == 0, "theme_park").otherwise("park").alias("type"), (F.col("c_custkey") % 64 / 64.0).alias("importance"))
    return acquisition.ranked_places(rows, "c_nationkey", F.lit("customer#00000001")).select("c_nationkey", "place", "name", "score")


def raster_alignment(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    meta = lambda shift, wide: read(spark, d, "part").select("p_partkey", (F.lit(100) + wide).alias("width"), F.lit(50).alias("height"), (k * 10.0 + shift).alias("min_x"), F.lit(0.0).alias("min_y"), (k * 10.0 + 100).alias("max_x"), F.lit(50.0).alias("max_y"), F.lit(1.0).alias("resolution"))
    return acquisition.alignment(meta(F.lit(0.0), F.lit(0)), meta(k % 3 * 0.0008, F.when(k % 5 == 0, 1).otherwise(0)), "p_partkey")


def uncached_requests(spark: SparkSession, d: str) -> DataFrame:
    key = acquisition.cache_key(F.lit("doc"), F.col("o_custkey").cast("string")).alias("key")
    asked = read(spark, d, "orders").select(key).distinct()
    return acquisition.to_fetch(asked, read(spark, d, "orders").filter("o_orderstatus = 'F'").select(key).distinct(), "key")


def corpus_seeding(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("content"))
    return acquisition.seeded(docs, read(spark, d, "part").filter("p_size % 3 = 0").select("p_partkey", F.col("p_brand").alias("content")), "p_partkey")


def tile_coverage(spark: SparkSession, d: str) -> DataFrame:
    x, z = F.col("x") / 10.0, F.col("z") / 10.0
    tiles = points(spark, d).select("vec_id", x.alias("west"), (x + 2).alias("east"), z.alias("south"), (z + 3).alias("north"))
    return acquisition.covering(tiles, -5.0, -4.0, 6.0, 1.5).select("vec_id")


def cloud_provenance(spark: SparkSession, d: str) -> DataFrame:
    clouds = read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("/data/Cloud_"), F.pmod("o_custkey", F.lit(40)).cast("string"), F.lit(".LAZ")).alias("file"))
    tiles = read(spark, d, "supplier").select(F.concat(F.lit("tiles\\cloud_"), F.pmod("s_suppkey", F.lit(25)).cast("string"), F.lit(".laz")).alias("file"), F.col("s_name").alias("tile"), F.col("s_nationkey").alias("flown"), F.col("s_suppkey").alias("seq"))
    return acquisition.provenance(clouds, tiles).select("o_orderkey", "tile", "flown")


def tag_inheritance(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "orders").select("o_orderkey", F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("tags"))
    old = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.create_map(F.lit("status"), F.lit("old"), F.lit("flag"), F.col("l_returnflag"), F.lit("line"), F.col("l_linestatus")).alias("tags"))
    got = acquisition.inherited_tags(own, old, "o_orderkey")
    return got.select("o_orderkey", F.col("tags")["status"].alias("status"), F.col("tags")["flag"].alias("flag"), F.col("tags")["line"].alias("line"))


def fusion_statistics(spark: SparkSession, d: str) -> DataFrame:
    made = F.get(F.array(*map(F.lit, ("accepted", "duplicate", "partial", "replaced"))), F.pmod(F.col("l_partkey") * 3 + F.col("l_suppkey"), F.lit(4)).cast("int"))
    return acquisition.fusion_counts(read(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_suppkey") % 10 == 3, "duplicate").otherwise(made).alias("decision")), "l_suppkey")


def compact_seed(spark: SparkSession, d: str) -> DataFrame:
    point = lambda a, b: F.struct((F.col("x") / 7.0 + a).alias("x"), (F.col("z") / 3.0 - b).alias("z"))
    rows = points(spark, d).select(F.pmod("vec_id", F.lit(50)).alias("doc"), F.concat(F.lit("k"), F.col("kind").cast("string")).alias("kind"), F.array(point(0, 0), point(1.255, 2), point(-4, 0.5)).alias("line"))
    got = acquisition.compact_lines(rows.union(rows), read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("doc")), "doc")
    return got.select("doc_no", "kind_no", F.array_join(F.col("dx").cast("array<string>"), ",").alias("dx"), F.array_join(F.col("dz").cast("array<string>"), ",").alias("dz"))


def surface_shapes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = read(spark, d, "part").select("p_partkey", *STYLE.columns())
    return rows.select("p_partkey", acquisition.pattern(c("pattern"), c("material")).alias("p"), acquisition.quarter_turn(c("turn")).alias("turn"), acquisition.shaped_block(c("block"), c("shape"), c("direction")).alias("block")).select("p_partkey", "p.pattern", "p.scale", "turn", "block")


QUERIES = {f.__name__: f for f in (place_ranking, raster_alignment, uncached_requests, corpus_seeding, tile_coverage, cloud_provenance, tag_inheritance, fusion_statistics, compact_seed, surface_shapes)}

_PTS = "(SELECT vec_id, CAST(floor(CAST(embedding[1] AS DOUBLE)*1000) AS BIGINT) AS x, CAST(floor(CAST(embedding[2] AS DOUBLE)*1000) AS BIGINT) AS z, label AS kind FROM embeddings)"
_cm = lambda c: f"CAST(floor(({c}) * 100 + 0.5) AS BIGINT)"
_FAMILY = {"red_terracotta": "brick", "dark_oak_planks": "dark_oak", "stone": "stone_brick", "cut_sandstone": "sandstone", "oak_log": "oak"}
_family = "CASE block " + " ".join(f"WHEN 'minecraft:{b}' THEN '{f}'" for b, f in _FAMILY.items()) + " ELSE 'stone_brick' END"
ORACLE_SQL = {
    "place_ranking": "SELECT c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY s DESC, c_name) AS INT) AS place, c_name AS name, s AS score FROM (SELECT c_nationkey, c_name, c_custkey % 64 / 64.0::DOUBLE + CASE WHEN c_custkey % 9 = 0 THEN 10 ELSE 0 END + CASE WHEN starts_with(lower(c_name), 'customer#00000001') THEN 2 ELSE 0 END AS s FROM customer) QUALIFY place <= 5",
    "raster_alignment": "SELECT p_partkey, p_partkey % 5 <> 0 AND p_partkey % 3 < 2 AS aligned FROM part",
    "uncached_requests": "SELECT DISTINCT sha256('doc' || chr(10) || o_custkey) AS key FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "corpus_seeding": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 3 = 0 THEN p_brand END AS content, CASE WHEN p_size % 2 = 0 THEN 'own' WHEN p_size % 3 = 0 THEN 'corpus' ELSE 'missing' END AS origin FROM part",
    "tile_coverage": f"SELECT vec_id FROM {_PTS} WHERE x / 10.0 <= 6 AND x / 10.0 + 2 >= -5 AND z / 10.0 <= 1.5 AND z / 10.0 + 3 >= -4",
    "cloud_provenance": "SELECT o_orderkey, s_name AS tile, s_nationkey AS flown FROM orders LEFT JOIN (SELECT s_suppkey % 25 AS k, arg_min(s_name, s_suppkey) AS s_name, arg_min(s_nationkey, s_suppkey) AS s_nationkey FROM supplier GROUP BY 1) ON k = o_custkey % 40",
    "tag_inheritance": "SELECT o_orderkey, o_orderstatus AS status, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS flag, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END AS line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "fusion_statistics": """
WITH f AS (SELECT l_suppkey, CASE WHEN l_suppkey % 10 = 3 THEN 'duplicate' ELSE list_extract(['accepted', 'duplicate', 'partial', 'replaced'], (l_partkey * 3 + l_suppkey) % 4 + 1) END AS d FROM lineitem)
SELECT l_suppkey, count(*) AS considered, count_if(d = 'accepted') AS accepted, count_if(d = 'duplicate') AS duplicate, count_if(d = 'partial') AS partial, count_if(d = 'replaced') AS replaced, CASE WHEN count_if(d IN ('accepted', 'replaced')) > 0 THEN 'active' ELSE 'nothing-new' END AS status FROM f GROUP BY 1""",
    "compact_seed": f"""
WITH f AS (SELECT DISTINCT vec_id % 50 AS doc, 'k' || kind AS kind, x / 7.0::DOUBLE AS x, z / 3.0::DOUBLE AS z FROM {_PTS} WHERE vec_id % 50 IN (SELECT n_nationkey FROM nation)),
n AS (SELECT dense_rank() OVER (ORDER BY doc) - 1 AS doc_no, dense_rank() OVER (ORDER BY kind) - 1 AS kind_no, [{_cm('x + 0')}, {_cm('x + 1.255::DOUBLE')}, {_cm('x - 4')}] AS px, [{_cm('z - 0')}, {_cm('z - 2')}, {_cm('z - 0.5::DOUBLE')}] AS pz FROM f)
SELECT CAST(doc_no AS INT) AS doc_no, CAST(kind_no AS INT) AS kind_no, px[1] || ',' || (px[2] - px[1]) || ',' || (px[3] - px[2]) AS dx, pz[1] || ',' || (pz[2] - pz[1]) || ',' || (pz[3] - pz[2]) AS dz FROM n""",
    "surface_shapes": f"""
WITH s AS (SELECT *, {_family} AS family, CASE direction WHEN 'north' THEN '2' WHEN '3' THEN '3' WHEN 'East' THEN '3' ELSE '0' END AS way FROM (SELECT p_partkey, {STYLE.sql()} FROM part))
SELECT p_partkey, CASE pattern WHEN 'Stack bond' THEN 'grid' WHEN 'herringbone' THEN 'herringbone' WHEN 'Random' THEN 'mixed' WHEN 'running-bond' THEN 'running_bond' ELSE CASE material WHEN 'brick' THEN 'running_bond' WHEN 'gravel' THEN 'speckled' WHEN 'wood' THEN 'stripes' WHEN 'paving_stones' THEN 'slabs' WHEN 'sett' THEN 'mosaic' ELSE 'solid' END END AS pattern,
 CAST(CASE WHEN material IN ('gravel', 'paving_stones') THEN 2 ELSE 1 END AS INT) AS scale, CAST(CASE turn WHEN '45' THEN 90 WHEN '-100 deg' THEN 270 WHEN '271.5' THEN 270 ELSE 0 END AS INT) AS turn,
 CASE shape WHEN 'Slab' THEN 'minecraft:' || family || '_slab[minecraft:vertical_half=bottom]' WHEN 'stairs' THEN 'minecraft:' || family || '_stairs[upside_down_bit=false,weirdo_direction=' || way || ']' WHEN 'WALL' THEN 'minecraft:' || CASE WHEN family IN ('sandstone', 'brick', 'stone_brick') THEN family ELSE 'cobblestone' END || '_wall'
 WHEN 'fence' THEN 'minecraft:' || CASE WHEN family IN ('dark_oak', 'oak') THEN family ELSE 'oak' END || '_fence' WHEN 'trapdoor' THEN 'minecraft:' || CASE WHEN family IN ('dark_oak', 'oak') THEN family ELSE 'oak' END || '_trapdoor[direction=' || way || ',open_bit=false,upside_down_bit=false]' ELSE block END AS block FROM s""",
}
