import pytest

from fleetspark.plans import catalog, stream_catalog
from tests.compare import connection, same

SF = "/root/testdata/sf0.001"
SLOW = {"shortest_paths", "route_requests"}


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in SLOW])
def test_query_equals_sql(spark, name):
    same(catalog.QUERIES[name](spark, SF), connection(SF), catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(SLOW))
def test_routes_equal_sql(spark, name):
    same(catalog.QUERIES[name](spark, SF), connection(SF), catalog.ORACLES[name])


@pytest.mark.parametrize("name", list(stream_catalog.QUERIES))
def test_stream_equals_batch(spark, name):
    same(stream_catalog.QUERIES[name](spark, SF), connection(SF), stream_catalog.ORACLES[name])
