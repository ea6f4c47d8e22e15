"""Reading inputs, cutting lineage and digests: what every corpus query shares."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.tables import Scratch, discard, saved, saved_at  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts go to Python at most `rows` at a time from now on in this session: with Spark's 10000, tens of MB stand in each buffer of a task. A smaller setting stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= rows:  # zero or less: no limit
        spark.conf.set(setting, rows)


def release(df: DataFrame) -> None:
    """Lets Spark drop shuffle files of finished steps; else they stay until the driver happens to collect garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def packed(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """docs as its needed columns and a struct of all others, so that no column of an operator meets one of docs; and the columns of docs, to select from what the operator returns."""
    used, others = list(dict.fromkeys(c for c in needed if c in docs.columns)), [c for c in docs.columns if c not in needed]
    inside = F.struct(*others) if others else F.struct(F.lit(None).alias("none"))
    return docs.select(*used, inside.alias("_others")), [F.col(c) if c in used else F.col("_others").getField(c).alias(c) for c in docs.columns]


def with_found(docs: DataFrame, found: DataFrame, text: str, id: str, column: str) -> tuple[DataFrame, str]:
    """docs with a column of `found` (row_a, row_b, column), met by row_key; and the column's name, one that no column of docs has."""
    names, name = docs.columns, column
    while name in names:
        name += "_"
    keyed = docs.select(F.struct(*names).alias("_doc"), *row_key(id, text))
    return keyed.join(found, ["row_a", "row_b"], "left").select(*(F.col("_doc").getField(c).alias(c) for c in names), F.col(column).alias(name)), name


def row_key(*columns: str) -> list[Column]:
    """Two independent 64-bit hashes of the given columns; rows that agree in all of them share the key.

    A null and an absent value hash alike for one column but not for the row as each column adds its null flag.
    """
    whole = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(*whole).alias("row_a"), F.xxhash64(F.lit(7), *reversed(whole)).alias("row_b")]
