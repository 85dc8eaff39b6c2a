import pytest

from taintlake.plans import catalog

from .compare import from_duckdb, from_spark

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    columns, rows = from_spark(catalog.QUERIES[name](spark, SF))
    wanted, other = from_duckdb(catalog.ORACLE_SQL[name], SF)
    assert columns == wanted
    assert rows == other, (list((rows - other).items())[:3], list((other - rows).items())[:3])
