"""Input tables and the views that queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on a metre grid from the first two embedding dimensions."""
    at = lambda i: F.floor(F.col("embedding")[i].cast("double") * 1000).cast("bigint")
    return read(spark, sf_dir, "embeddings").select("vec_id", at(0).alias("x"), at(1).alias("z"), F.col("label").alias("kind"), "embedding")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measured line per order: measure in quantities, elevation missing where the discount is 5 %."""
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    elevation = F.when(F.col("l_discount") != 0.05, F.col("l_extendedprice"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("track_id"), F.row_number().over(along).alias("seq"),
        F.sum("l_quantity").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("measure"), elevation.alias("elevation"),
    )
