"""Every core query against its SQL on the smallest tables."""

import os

import pytest

from evigraph.plans import domain, entities, rules  # noqa: F401  they register their queries too
from evigraph.plans.queries import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, db, sf, name):
    frame = QUERIES[name](spark, sf)
    cols = sorted(frame.columns)
    result = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in result.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in frame.collect()), key=str) == want
