import os

import pytest

from workload.check import database, difference
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), database(SF).execute(ORACLE[name]).df()) is None
