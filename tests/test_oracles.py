"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from keylingo import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(tuple(plain(r[n]) for n in order) for r in data)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, sql, name):
    df = plans.queries()[name](spark, SF)
    got = df.collect()
    cursor = sql.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0
