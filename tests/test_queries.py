"""Each registered relational query against DuckDB on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from heddle import queries as registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in registry.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(columns).collect())
    rel = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in rel.description]
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in rel.fetchall())
    assert columns == sorted(names) and got == want


def test_entry_module_offers_all(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(registry.ORACLE) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name, table", [("q_projection_arithmetic", "lineitem"), ("q_predicates_3vl", "events"), ("q_join_cross", "nation"), ("q_unnest_offset", "embeddings")])
def test_a_query_over_the_whole_table_is_registered(spark, duck, name, table):
    rows = {"nation": "SELECT count(*) * (SELECT count(*) FROM region) FROM nation", "embeddings": "SELECT sum(len(embedding)) FROM embeddings"}
    want = duck.execute(rows.get(table, f"SELECT count(*) FROM {table}")).fetchone()[0]
    assert registry.QUERIES[name](spark, FOLDER).count() == want
