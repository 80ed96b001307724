"""Operators on literal rows against their SQL."""

import literal_rows
import pytest

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(literal_rows.QUERIES))
def test_rows(spark, sf, name):
    frame = literal_rows.QUERIES[name](spark, sf)
    result = duckdb.connect().execute(literal_rows.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted((tuple(r[c] for c in names) for r in frame.collect()), key=str) == sorted(result.fetchall(), key=str)
