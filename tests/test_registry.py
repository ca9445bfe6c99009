"""Every registered query gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

from seriate import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


def rows(frame, columns):
    def text(v):
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(tuple(map(text, r)) for r in values.values.tolist())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_ties_of_balances_equal_sql(spark, tmp_path):
    """Of customers with one balance the SQL takes the least and the greatest key."""
    connection = duckdb.connect()
    connection.sql(f"copy (select c.* replace (cast(c_custkey + 1000000 * i as bigint) as c_custkey) from range(3) r(i), '{DATA}/customer.parquet' c) to '{tmp_path}/customer.parquet'")
    connection.sql(f"create view customer as select * from '{tmp_path}/customer.parquet'")
    got, want = registry.queries()["min_max_by"](spark, str(tmp_path)).toPandas(), connection.sql(registry.oracle_sql()["min_max_by"]).df()
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
