"""Every registered query against its SQL equivalent in DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entry_point.queries()))
def test_query(spark, sf, duck, name):
    df = entry_point.queries()[name](spark, sf)
    found = df.collect()
    assert found
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    columns = [column[0] for column in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = [dict(zip(columns, row)) for row in result.fetchall()]
    as_text = [sorted(repr([row[c] for c in sorted(columns)]) for row in rows) for rows in (found, expected)]
    assert as_text[0] == as_text[1]


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry_is_the_training_query(spark, monkeypatch):
    """That query runs above, with its whole grid."""
    monkeypatch.setitem(entry_point.QUERIES, "train_and_score", lambda *given: given)
    assert entry_point.entry(spark) == (spark, "/root/testdata/sf0.001")


def test_no_local_checkpoint_or_cross_join():
    sources = "\n".join(p.read_text() for p in Path(entry_point.__file__).parent.glob("coppice/**/*.py"))
    assert "localCheckpoint" not in sources and "crossJoin" not in sources
