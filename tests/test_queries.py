"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from loomfield.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "part events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) >= 60


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    text = lambda x: repr(x) if isinstance(x, float) else str(x)
    want = sorted(tuple(text(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(map(text, r)) for r in df.select(*columns).collect()) == want
