"""Every registered query on the smallest tables, against its SQL where there is one."""

import pytest

from slatewise.queries.load import all_queries
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    entry = QUERIES[name]
    rows = entry.run(spark, FOLDER).toPandas()
    if entry.sql is None:
        assert len(rows) > 0
    else:
        assert compare(rows, duck.execute(entry.sql).df()) is None
