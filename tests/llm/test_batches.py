"""How many texts the pipeline sends to Python at once."""

from __future__ import annotations

import pyarrow as pa

import corpus_pipeline

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def sizes(docs) -> list[int]:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    return [r.n for r in docs.mapInArrow(run, "n long").collect()]


def test_stages_send_texts_in_small_batches(spark):
    docs = spark.range(1200).coalesce(1).selectExpr("id AS doc_id", "concat('Words of text ', id) AS text", "'en' AS lang", "'s' AS source", "1 AS n_chars")
    before = spark.conf.get(SETTING)
    try:
        for given, most in (("10000", 500), ("0", 500), ("200", 200)):
            spark.conf.set(SETTING, given)
            corpus_pipeline.quality_rules_stage(spark, docs, "")
            got = sizes(docs)
            assert sum(got) == 1200 and max(got) == most
    finally:
        spark.conf.set(SETTING, before)
