"""Every registered query outside the corpus subpackage against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from fieldloom.plans import catalogue
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLE_SQL:
        assert_same(df, duck, catalogue.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_continuity_choice_takes_all_orders(spark, sf_dir):
    got = catalogue.QUERIES["continuity_choice"](spark, sf_dir).select("l_orderkey").distinct().count()
    assert got == spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").distinct().count()
