"""Readers with fixed schemas: GeoJSON, map snapshots, manifests, point lists, delimited text, line-wise partitions.

All read through Spark, so any path that the cluster can open will do; wrong files fail on read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<lat:double,lon:double>"
MAP_SNAPSHOT = f"""version double, generator string, elements array<struct<type:string,id:bigint,timestamp:string,version:int,lat:double,lon:double,
tags:map<string,string>,geometry:array<{POINT}>,members:array<struct<type:string,ref:bigint,role:string,geometry:array<{POINT}>>>>>"""
GEOJSON = """type string, name string, source struct<name:string,url:string,license:string,dataset:string>,
features array<struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"""
MANIFEST = """schemaVersion int, id string, parkId string, reviewedAt string, documents array<struct<id:string,applicationReference:string,applicationStatus:string,
role:string,sourceUrl:string,file:string,mime:string,sha256:string,acquire:boolean,publishedAt:string,decisionDate:string,worldEligible:boolean,worldEligibilityBasis:string>>"""


def map_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One row per element, in file order (seq)."""
    raw = spark.read.schema(MAP_SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select(F.posexplode("elements").alias("seq", "e")).select("seq", "e.*")


def snapshot_bounds(elements: DataFrame, pad: float = 0.0001) -> DataFrame:
    """Bounds of all coordinates of nodes, ways and members, padded."""
    lists = F.concat(F.array(F.struct("lat", "lon")), F.coalesce("geometry", F.array().cast(f"array<{POINT}>")), F.coalesce(F.flatten(F.transform("members", lambda m: F.coalesce(m.geometry, F.array().cast(f"array<{POINT}>")))), F.array().cast(f"array<{POINT}>")))
    p = elements.select(F.explode(lists).alias("p")).filter("p.lat is not null and p.lon is not null")
    return p.agg((F.min("p.lat") - pad).alias("south"), (F.min("p.lon") - pad).alias("west"), (F.max("p.lat") + pad).alias("north"), (F.max("p.lon") + pad).alias("east"))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature with its collection's source; coordinates stay text, as their depth varies."""
    raw = spark.read.schema(GEOJSON).option("multiLine", True).json(path)
    kind = F.when(F.col("type") == "FeatureCollection", F.col("type")).otherwise(F.raise_error(F.lit("not a FeatureCollection")))
    return raw.withColumn("type", kind).select(F.col("source").alias("collection"), F.posexplode("features").alias("seq", "f"), "type").filter("type is not null").select(
        "seq", "collection", F.coalesce("f.id", F.col("f.properties")["id"]).alias("id"), F.col("f.geometry.type").alias("shape"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("tags")
    )


def vertices(shape: Column, coordinates: Column) -> Column:
    """Polygons of rings of vertices, whatever the depth: a point is one vertex, a line one ring."""
    deep = "array<array<array<array<double>>>>"
    at = lambda kind, opening: F.from_json(F.concat(F.lit("[" * opening), coordinates, F.lit("]" * opening)), deep)
    return F.when(shape == "Point", at("Point", 3)).when(shape.isin("LineString", "MultiPoint"), at("LineString", 2)).when(shape.isin("Polygon", "MultiLineString"), at("Polygon", 1)).when(shape == "MultiPolygon", at("MultiPolygon", 0)).otherwise(F.raise_error(F.concat(F.lit("unsupported geometry "), shape)).cast(deep))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path).select("id", "parkId", F.posexplode("documents").alias("seq", "d")).select(F.col("id").alias("manifest_id"), "seq", "d.*")


def manifest_problems(documents: DataFrame) -> DataFrame:
    """(problem, id): repeated ids, missing fields, eligibility without a basis."""
    many = documents.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("repeated id").alias("problem"), "id")
    lacks = documents.filter("id is null or applicationReference is null or role is null").select(F.lit("missing field").alias("problem"), "id")
    basis = documents.filter("worldEligible and coalesce(trim(worldEligibilityBasis), '') = ''").select(F.lit("no basis").alias("problem"), "id")
    return many.union(lacks).union(basis)


def point_list(spark: SparkSession, path: str) -> DataFrame:
    """{crs, points: [[x, y, z, class, intensity], ...]} as rows."""
    raw = spark.read.schema("crs string, points array<array<double>>").option("multiLine", True).json(path)
    at = lambda i: F.try_element_at("p", F.lit(i))
    return raw.select("crs", F.posexplode("points").alias("seq", "p")).select("seq", at(1).alias("easting"), at(2).alias("northing"), at(3).alias("elevation"), at(4).cast("int").alias("class"), at(5).cast("int").alias("intensity"))


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """Quoted fields, doubled quotes; headers become lower-case letters and digits; blank rows go."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    names = ["".join(c for c in n.lower() if c.isalnum()) for n in raw.columns]
    return raw.toDF(*names).dropna("all")


def feature_lines(spark: SparkSession, path: str, least_confidence: float = 0.65) -> DataFrame:
    """Line-wise features (also gzipped); a known confidence below the least goes, unknown or negative ones pass."""
    raw = spark.read.schema("type string, geometry struct<type:string,coordinates:string>, properties struct<height:double,confidence:double>").json(path)
    c = F.col("properties.confidence")
    return raw.filter(c.isNull() | (c < 0) | (c >= least_confidence)).select(F.col("geometry.type").alias("shape"), F.col("geometry.coordinates").alias("coordinates"), F.col("properties.height").alias("height"), c.alias("confidence"))


def ranked_surveys(surveys: DataFrame) -> DataFrame:
    """Surveys with a resolution, the finest first, then the newest, then by name."""
    return surveys.filter("resolution_m > 0").orderBy(F.asc("resolution_m"), F.desc_nulls_last("flown"), F.asc("tile"))


def within_limit(rows: DataFrame, most: int, what: str) -> DataFrame:
    """Fails where there are more rows than allowed; nothing is cut off."""
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} {what}")
    return rows
