"""Tables that operators write on their way: they cut lineage, survive lost executors, and go when their last reader is through."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def saved_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows as a table in the shared folder, and its path."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder: it cuts the lineage, and a lost executor costs no more than a read."""
    return saved_at(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """The tables of one operator's call.

    discard() deletes those that nothing reads any more. What the returned frame still reads stays until the application's folder goes.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def saved(self, df: DataFrame) -> DataFrame:
        out, path = saved_at(df)
        self.paths[id(out)] = (path, out)
        return out

    def discard(self, *tables: DataFrame, but: DataFrame | tuple[DataFrame, ...] = ()) -> None:
        """Deletes the given tables, or all but `but`."""
        keep = {id(x) for x in ((but,) if isinstance(but, DataFrame) else but)}
        for k in [id(x) for x in tables] if tables else list(self.paths):
            if k in self.paths and k not in keep:
                discard(self.spark, self.paths.pop(k)[0])
