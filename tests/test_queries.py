"""Every registered query outside the llm package against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from paperloom.plans.registry import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for p in Path(SMALL).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


def plain(value):
    return round(value, 6) if isinstance(value, float) and math.isfinite(value) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_return_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_concept_grades_of_sharp_s(spark, tmp_path):
    """A concept folded from ß is looked for in texts that keep it, as in the SQL: as a whole term it is there, inside a longer one it is not."""
    turns = [(1, 0, "Enß zu gut"), (1, 1, "großenß und zu"), (1, 2, "ein enß"), (2, 0, "Äß als Chber"), (2, 1, "xäß als"), (2, 2, "ÄSS chbern"), (2, 3, None), (3, 0, "eins"), (4, 0, None)]
    spark.createDataFrame([(a, b, "user", c) for a, b, c in turns], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df, result = QUERIES["concept_grades"](spark, str(tmp_path)), own.execute(SQL["concept_grades"])
    columns = [c[0] for c in result.description]
    found = rows(df.columns, df.collect())
    assert found == rows(columns, result.fetchall())
    assert [(r["graph"], r["missing"]) for r in df.orderBy("graph").collect()] == [(1, 1), (2, 0), (3, 1)]
