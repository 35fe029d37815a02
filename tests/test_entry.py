"""Every query of the recovery engine against its SQL."""

import pytest

import __spark_entry__
from tests.oracle import assert_same
from tidewrack.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_is_its_sqls(spark, sf_dir, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "bytes", "known", "mark"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
