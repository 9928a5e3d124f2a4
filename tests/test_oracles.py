import os

import pytest

from spanloom.queries import ORACLE, QUERIES
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    oracle.compare(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    QUERIES[name](spark, oracle.DATA).toPandas()


def test_windows_and_rows_decode_alike(spark):
    a = QUERIES["T14_decoded"](spark, oracle.DATA).toPandas()
    b = QUERIES["T14_W2_decoded_by_windows"](spark, oracle.DATA).toPandas()
    assert oracle.rows(a) == oracle.rows(b)
