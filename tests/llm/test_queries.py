import pytest

import compare
from traceloom.llm import oracle, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_training_data_queries_equal_sql(spark, con, name):
    compare.same_rows(queries.queries()[name](spark, SMALL), con, oracle.oracle_sql()[name])


def test_only_these_have_no_sql():
    assert queries.queries().keys() - oracle.oracle_sql().keys() == {"p7_ids", "p8_packed", "p8_in_bucket", "p8_report"}
