"""A few whole queries against DuckDB; the driver checks all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["a1_leave_two_out_popular_eval", "a4_user_segments", "a5_train_history", "b3_popular_route", "e3_history_flags", "j4_rating_share", "k2_dominant_label", "g12_rule_labels"])
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    expected = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(expected.columns) == columns
    key = lambda row: tuple(str(round(x, 6) if isinstance(x, float) else float(x) if hasattr(x, "as_tuple") else x) for x in row)
    mine = sorted(key(tuple(r[c] for c in columns)) for r in got.collect())
    theirs = sorted(key(tuple(r[expected.columns.index(c)] for c in columns)) for r in expected.fetchall())
    assert mine == theirs


def test_every_oracle_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
