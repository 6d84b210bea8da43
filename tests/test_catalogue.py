"""Every query against its DuckDB statement, and those without one for their rows."""

import os

import pytest
from oracle import differences, plain

from leafmill.plans import catalogue

FOLDER = os.environ.get("LEAFMILL_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, name):
    assert differences(spark, FOLDER, catalogue.queries()[name], catalogue.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_same_rows_however_partitioned(spark, name):
    """Without a statement: the same rows over three partitions as over eight, none of them twice."""
    rows = lambda: sorted((repr(plain(r)) for r in catalogue.queries()[name](spark, FOLDER).collect()))
    over_eight = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows() == over_eight and len(set(over_eight)) == len(over_eight)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_entry(spark):
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
