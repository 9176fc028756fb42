"""Every registered query against its SQL check on the smallest driver tables."""

import os

import oracle
import pytest

from riskloom.plans.catalog import QUERIES, SQL

SF_DIR = f"{oracle.DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    message = oracle.compare(spark, con, name, QUERIES[name], SQL[name], SF_DIR)
    assert message is None, message


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) >= 4 and set(rows[0].asDict()) == {"name", "auc", "threshold", "specificity", "sensitivity"}
    assert entry.queries().keys() >= entry.oracle_sql().keys()
