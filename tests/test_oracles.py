import pytest

import __spark_entry__ as entry_module
from oracle import connection, differences

SF = "/root/testdata/sf0.001"
NAMES = sorted(k for r in entry_module.REGISTRIES for k in r.queries)


@pytest.fixture(scope="module")
def con():
    return connection(SF)


#: DuckDB's views don't show files; tests/test_whole.py has brute force.
WITHOUT_SQL = {"h01_file_digests"}


@pytest.mark.parametrize("name", sorted(set(NAMES) - WITHOUT_SQL))
def test_query_equals_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    sql = entry_module.oracle_sql().get(name)
    assert sql, "no SQL"
    assert not differences(df, con, sql)


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["n", "b", "c", "p"]
