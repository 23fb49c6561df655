"""Every named query against its SQL."""

import math
import warnings

import duckdb
import pytest

from marginalia.plans import queries as named

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations benchmark pages".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(named.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = named.queries()[name](spark, sf_dir)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = duck.sql(named.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(named.queries()) - set(named.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    assert named.queries()[name](spark, sf_dir).count() > 0
