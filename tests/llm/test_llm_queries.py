"""The queries of the subpackage on the smallest data, against SQL where there is any."""

import os

import duckdb
import pytest

from cueloom.llm import registry
from tests.test_queries import SF, rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in registry.ORACLES:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
        assert rows(got) == rows(con.sql(registry.ORACLES[name]).df())
