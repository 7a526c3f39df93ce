import os

import pytest

import __spark_entry__ as contract
from suite.check import difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_oracle(spark, name):
    assert difference(contract.queries()[name](spark, SF_DIR), SF_DIR, contract.oracle_sql()[name]) is None
