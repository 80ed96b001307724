"""Queries that SQL can express against their SQL."""

import pytest

from evigraph.llm.queries import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name,table", [("op4_url_filter", "pages"), ("op6_chat_format", "conversations"), ("op12_ranked_search", "documents benchmark")])
def test_query(spark, sf, name, table):
    db = duckdb.connect()
    for t in table.split():
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    frame = QUERIES[name](spark, sf)
    result = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted((tuple(r[c] for c in names) for r in frame.collect()), key=str) == sorted(result.fetchall(), key=str)
