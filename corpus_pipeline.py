"""A corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last two return the columns
of documents; mixing adds each row's place in the mix (mix), which decides the slots of the shards. run() writes every stage as a table in the shared folder and reads it again.
Stages that send texts to Python set the session's Arrow batches to 500 rows, or leave a smaller setting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import fm_index, hilbert_sharding, pfair_mixing, quality_rules, simhash
from fieldloom.llm._tables import saved, small_batches, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base check or are probably bad go."""
    small_batches(spark)
    return quality_rules.filtered(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies stays."""
    small_batches(spark)
    return simhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark windows are cut out; documents of which nothing is left go."""
    small_batches(spark)
    return fm_index.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, with their place in it."""
    return pfair_mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot; slots follow the mix."""
    return hilbert_sharding.sharded(docs, order="mix")


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pfair_mixing", mixing_stage),
    ("hilbert_sharding", sharding_stage),
]
#: SQL can't express the posterior of the rules, nor the components of near copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
