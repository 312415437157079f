"""Every registered query against its SQL on the given tables."""

import pytest

import __spark_entry__ as driver
from anchorline import registry
from oracle_check import compare, duck

DUCK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}
QUERIES = registry.queries()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    described = con.execute(f"DESCRIBE {SQL[name]}").fetchall()
    assert {c: DUCK_TYPES[t] for c, t in df.dtypes} == {row[0]: row[1] for row in described}
    actual, expected = compare(df, con, SQL[name])
    assert actual == expected
    assert expected[1]


def test_entry(spark, sf_dir):
    assert driver.entry(spark).count() > 0
