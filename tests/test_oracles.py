"""Every query that SQL can express gives the rows of its SQL."""

import math

import duckdb
import pytest

from cotejo.plans import details, sites  # noqa: F401  register their queries
from cotejo.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return [columns[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: [(v is not None, v) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, database, name):
    got = QUERIES[name](spark, FOLDER)
    want = database.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert canonical(got.columns, got.collect()) == canonical(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).columns
    assert QUERIES[name](spark, FOLDER).count() >= 0
