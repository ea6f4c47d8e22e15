"""Queries over authority, evidence, set operations, limits, colours and buildings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.functions.numbers import half_up
from fieldloom.operators import authority, features
from fieldloom.plans.made import Made
from fieldloom.plans.tables import points, read
from fieldloom.sources import sinks


def _rows(spark: SparkSession, d: str) -> DataFrame:
    n = F.pmod(F.col("doc_id"), F.lit(6))
    return read(spark, d, "documents").select(
        "doc_id", F.when(n == 0, "OpenStreetMap").when(n == 1, "Council").otherwise("Survey").alias("provider"), F.when(n == 2, F.concat(F.lit("osm:way/"), "doc_id")).when(n == 5, F.concat(F.lit("overture:"), "doc_id")).otherwise(F.concat(F.lit("f"), "doc_id")).alias("id"),
        F.when(n == 3, '[{"dataset":"OSM"}]').alias("upstream"), (n == 1).alias("planning"), F.when(F.col("n_chars") > 3000, "implausible-span").alias("outlier"),
        F.element_at(F.array(F.lit("vegetation"), F.lit("building"), F.lit("water"), F.lit("path")), (F.pmod(F.col("doc_id"), F.lit(4)) + 1).cast("int")).alias("kind"), (F.col("lang") == "es").alias("excluded"),
    )


def authority_disposition(spark: SparkSession, d: str) -> DataFrame:
    derived = authority.map_derived(F.col("provider"), F.col("id"), F.col("upstream"))
    return _rows(spark, d).select("doc_id", authority.disposition(F.col("excluded"), derived, F.col("planning"), F.col("outlier"), F.col("kind")).alias("disposition"))


def authority_counts(spark: SparkSession, d: str) -> DataFrame:
    return authority_disposition(spark, d).groupBy("disposition").agg(F.count("*").alias("n"))


def evidence_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("property"), F.col("l_linestatus").alias("value"), F.lit("s").alias("source"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("n"))
    merged = authority.merge_evidence(rows, "l_orderkey", "n")
    return merged.select("l_orderkey", F.array_join(F.transform("evidence", lambda e: F.concat(e.property, F.lit(":"), e["value"])), ",").alias("evidence"))


VERTICAL = Made("p_partkey", {"height": [3.0, None, 7.5], "height_source": ["OSM tag", "survey", "retained-during-planning-override", None, "lidar"], "height_confidence": [0.5, 0.9], "elevation": [100.0, None], "elevation_source": ["osm:ele", "lidar", None]})


def inherited_heights(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", authority.scrubbed(F.struct(*VERTICAL.columns())).alias("v")).select("p_partkey", "v.*")


FENCE = Made("p_partkey", {"semantic": ["Construction-Fence", "fence", None, "wall", "site fence"], "barrier": ["fence", None, "wall"], "state": ["Temporary works", "permanent", None], "temporary": [True, None, False, None], "colour": ["Red", "#F00", "blue", None, "#ff0000", "dark red"]})


def construction_fences(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", authority.construction_fence(*(FENCE.column(c) for c in ("semantic", "barrier", "state", "temporary", "colour"))).alias("fence"))


SOURCE = Made("p_partkey", {"provider": ["Survey", "Planning office", None, "x"], "dataset": [None, "planning-data", "y"], "adapter": [None, "z", None, None, "planning"], "policy": [None, "planning-first", "keep"], "flagged": [None, None, True], "named": [None, "", "18/0042/FUL", None, None], "stated": [None, "cad", ""]})


def planning_authorities(spark: SparkSession, d: str) -> DataFrame:
    c = SOURCE.column
    world = authority.planning_world(*(c(n) for n in ("provider", "dataset", "adapter", "policy", "flagged", "named")))
    graph = authority.planning_graph(c("provider"), c("dataset"), c("flagged"), c("named"))
    return read(spark, d, "part").select("p_partkey", world.alias("world"), graph.alias("graph"), authority.attribution(c("stated"), c("named"), graph).alias("authority"))


def evidence_ranks(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, [*authority.EVIDENCE_RANK, "unheard-of"])), (F.pmod(F.col("l_partkey"), F.lit(9)) + 1).cast("int"))
    rows = read(spark, d, "lineitem").select("l_suppkey", kind.alias("evidence"))
    return rows.groupBy("l_suppkey").agg(F.max(authority.lookup(F.col("evidence"), authority.EVIDENCE_RANK)).alias("best"), F.sum(authority.lookup(F.col("evidence"), authority.EVIDENCE_RANK)).alias("total"))


def source_union(spark: SparkSession, d: str) -> DataFrame:
    return features.in_source_order([read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))], "id")


def set_differences(spark: SparkSession, d: str) -> DataFrame:
    a, b = read(spark, d, "orders").select(F.col("o_custkey").alias("k")), read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return features.set_report(a, b, "k")


def roofs(spark: SparkSession, d: str) -> DataFrame:
    samples = read(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity")).alias("x"), (F.col("l_linenumber") * 1.0).alias("z"), (F.col("l_discount") * F.pmod(F.col("l_suppkey"), F.lit(40))).alias("h"))
    return features.roofs(samples, ["l_suppkey"], "x", "z", "h").select("l_suppkey", "n", "form", half_up(F.col("relief"), 3).alias("relief"))


def width_ladder(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    stated, lanes = F.when(F.col("p_size") % 5 == 0, F.col("p_size") / 10), F.when(F.col("p_size") % 3 == 0, F.pmod(F.col("p_size"), F.lit(4)) + 1)
    kind = F.element_at(F.array(*map(F.lit, [*features.WIDTH_PRIORS, "unknown"])), (F.pmod(F.col("p_partkey"), F.lit(len(features.WIDTH_PRIORS) + 1)) + 1).cast("int"))
    w = features.width(stated, lanes, kind)
    return p.select("p_partkey", w["width"].alias("width"), w.status.alias("status"), w.confidence.alias("confidence"))


def observed_colours(spark: SparkSession, d: str) -> DataFrame:
    px = points(spark, d).select("kind", *(F.pmod(F.floor(F.col("embedding")[i].cast("double") * 1000), F.lit(256)).cast("double").alias(c) for i, c in enumerate("rgb")))
    return features.observed_colour(px, ["kind"])


def sign_lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.array_join(features.wrapped(F.concat_ws(" ", "p_name", "p_type", "p_brand"), 20, 4), "/").alias("lines"))


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select("n_nationkey", sinks.markdown_line(F.col("n_name"), F.col("n_regionkey"), F.lit(None)).alias("line"))


def label_semantics(spark: SparkSession, d: str) -> DataFrame:
    rules = [(k, f"(?i){k}") for k in ("ring", "widget", "bolt", "gear")]
    p = read(spark, d, "part")
    return p.select("p_partkey", text.cascade(F.col("p_name"), rules).alias("material")).filter("material is not null").groupBy("material").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (authority_disposition, authority_counts, evidence_merge, inherited_heights, construction_fences, planning_authorities, evidence_ranks, source_union, set_differences, roofs, width_ladder, observed_colours, sign_lines, report_lines, label_semantics)}

_ROWS = """(SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN true WHEN 2 THEN true WHEN 3 THEN true WHEN 5 THEN true ELSE false END AS derived, doc_id % 6 = 1 AS planning, CASE WHEN n_chars > 3000 THEN 'implausible-span' END AS outlier,
 list_extract(['vegetation', 'building', 'water', 'path'], doc_id % 4 + 1) AS kind, coalesce(lang = 'es', false) AS excluded FROM documents)"""
_DISPOSED = f"SELECT doc_id, CASE WHEN excluded THEN 'excluded' WHEN derived THEN 'map-derived' WHEN planning AND outlier IS NOT NULL THEN 'outlier:' || outlier WHEN planning THEN 'planning' WHEN kind IN ('vegetation', 'water', 'terrain_detail') THEN 'independent' ELSE 'not-planning' END AS disposition FROM {_ROWS}"
_kinds = list(features.WIDTH_PRIORS.values())
_width = " ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, (w, _) in enumerate(_kinds))
_trust = " ".join(f"WHEN {i} THEN {c}::DOUBLE" for i, (_, c) in enumerate(_kinds))
ORACLE_SQL = {
    "authority_disposition": _DISPOSED,
    "authority_counts": f"SELECT disposition, count(*) AS n FROM ({_DISPOSED}) GROUP BY 1",
    "evidence_merge": "SELECT l_orderkey, string_agg(p || ':' || v, ',' ORDER BY n, p, v) AS evidence FROM (SELECT l_orderkey, l_returnflag AS p, l_linestatus AS v, min(l_linenumber * 1000000 + l_partkey) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1",
    "inherited_heights": f"""
WITH v AS (SELECT p_partkey, {VERTICAL.sql()} FROM part), o AS (SELECT *, coalesce(height_source IN ('OSM tag', 'retained-during-planning-override'), false) AS h, coalesce(elevation_source = 'osm:ele', false) AS e FROM v)
SELECT p_partkey, CASE WHEN NOT h THEN height END AS height, CASE WHEN NOT h THEN height_source END AS height_source, CASE WHEN NOT h THEN height_confidence END AS height_confidence, CASE WHEN NOT e THEN elevation END AS elevation, CASE WHEN NOT e THEN elevation_source END AS elevation_source FROM o""",
    "construction_fences": f"""
SELECT p_partkey, coalesce(semantic = 'Construction-Fence', false) OR ((coalesce(state = 'Temporary works', false) OR coalesce(temporary, false)) AND (coalesce(semantic IN ('Construction-Fence', 'fence', 'site fence'), false) OR coalesce(barrier = 'fence', false)) AND coalesce(colour NOT IN ('blue'), false)) AS fence
FROM (SELECT p_partkey, {FENCE.sql()} FROM part)""",
    "planning_authorities": f"""
WITH s AS (SELECT p_partkey, {SOURCE.sql()} FROM part), g AS (SELECT *, coalesce(provider = 'Planning office', false) OR coalesce(dataset = 'planning-data', false) OR coalesce(flagged, false) OR coalesce(named, '') <> '' AS graph FROM s)
SELECT p_partkey, graph OR coalesce(adapter = 'planning', false) OR coalesce(policy = 'planning-first', false) AS world, graph, CASE WHEN stated = 'cad' THEN 'cad' WHEN coalesce(named, '') <> '' THEN named WHEN graph THEN 'planning-data' ELSE 'independent-evidence' END AS authority FROM g""",
    "evidence_ranks": "SELECT l_suppkey, CAST(max(CASE WHEN l_partkey % 9 = 8 THEN 0 ELSE l_partkey % 9 END) AS INT) AS best, CAST(sum(CASE WHEN l_partkey % 9 = 8 THEN 0 ELSE l_partkey % 9 END) AS BIGINT) AS total FROM lineitem GROUP BY 1",
    "source_union": "SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance, 0 AS source_order FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, 1 FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)",
    "set_differences": """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT CASE WHEN a.k IS NULL THEN 'only right' WHEN b.k IS NULL THEN 'only left' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""",
    "width_ladder": f"""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_size / 10.0::DOUBLE WHEN p_size % 3 = 0 THEN (p_size % 4 + 1) * 3.0::DOUBLE ELSE CASE p_partkey % {len(_kinds) + 1} {_width} END END AS width,
 CASE WHEN p_size % 5 = 0 THEN 'stated' WHEN p_size % 3 = 0 THEN 'lanes' WHEN p_partkey % {len(_kinds) + 1} < {len(_kinds)} THEN 'prior' ELSE 'unresolved' END AS status,
 CASE WHEN p_size % 5 = 0 THEN 0.9::DOUBLE WHEN p_size % 3 = 0 THEN 0.6::DOUBLE ELSE CASE p_partkey % {len(_kinds) + 1} {_trust} END END AS confidence FROM part""",
    "observed_colours": """
WITH px AS (SELECT label AS kind, ((CAST(floor(CAST(embedding[1] AS DOUBLE)*1000) AS BIGINT) % 256) + 256) % 256 AS r, ((CAST(floor(CAST(embedding[2] AS DOUBLE)*1000) AS BIGINT) % 256) + 256) % 256 AS g, ((CAST(floor(CAST(embedding[3] AS DOUBLE)*1000) AS BIGINT) % 256) + 256) % 256 AS b FROM embeddings),
l AS (SELECT *, 0.2126::DOUBLE*r + 0.7152::DOUBLE*g + 0.0722::DOUBLE*b AS light FROM px), m AS (SELECT kind, quantile_cont(light, 0.2) AS dark FROM l GROUP BY 1)
SELECT l.kind, count(*) AS n, quantile_cont(r::DOUBLE, 0.5) AS r, quantile_cont(g::DOUBLE, 0.5) AS g, quantile_cont(b::DOUBLE, 0.5) AS b FROM l JOIN m ON m.kind = l.kind WHERE light >= dark GROUP BY 1""",
    "report_lines": "SELECT n_nationkey, '| ' || n_name || ' | ' || n_regionkey || ' | - |' AS line FROM nation",
    "label_semantics": "SELECT * FROM (SELECT CASE WHEN p_name ILIKE '%ring%' THEN 'ring' WHEN p_name ILIKE '%widget%' THEN 'widget' WHEN p_name ILIKE '%bolt%' THEN 'bolt' WHEN p_name ILIKE '%gear%' THEN 'gear' END AS material, count(*) AS n FROM part GROUP BY 1) WHERE material IS NOT NULL",
}
