"""The dealt queries that SQL can express, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from paperloom.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SMALL)
    result = db.execute(SQL[name])
    order = [[c[0] for c in result.description].index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[k] for k in order)) for r in result.fetchall())
