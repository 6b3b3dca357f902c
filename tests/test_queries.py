"""Registered queries against their checking SQL: all but those of single structures (m01-m73), which TAMIS_ALL=1 adds."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()
CHOSEN = [n for n in SQL if not n.startswith("op") and (os.environ.get("TAMIS_ALL") or n[0] != "m" or n.startswith(("m21", "m47")) or "_deep_" in n or "_wide_" in n)]


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(str([plain(r[i]) for i in at]) for r in cursor.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).columns == ["k", "is_valid", "findings", "warning_codes", "test_name"]
    assert set(SQL) <= set(QUERIES)
