"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
import catalog
import oracles

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(oracles.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_sql(spark, db, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    result = db.execute(contract.oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert sorted(types) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    order = [list(types).index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    assert got == want and got


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 54
