"""Registered queries: against their checking SQL, or for shape and repeatability."""

import duckdb
import pytest

import __spark_entry__ as entry
from tamis.llm.queries import all_queries
from tests.conftest import SF

TABLES = "documents embeddings pages benchmark labels conversations".split()
ALL = {q.name: q for q in all_queries()}
COUNTED = {"op2_html_extraction": "pages", "op3_mixing_sources": "documents", "op6_chat_formatting": "conversations", "op8_toxicity": "documents",
           "op9_quality_classifier": "documents", "op10_url_filters": "pages"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_all_registered():
    assert sorted(n.split("_")[0] for n in ALL) == sorted(f"op{i}" for i in range(1, 14))
    assert {*ALL, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n, q in ALL.items() if q.sql])
def test_sql(spark, con, name):
    df = ALL[name].run(spark, SF)
    columns = sorted(df.columns)
    ours = sorted(str([r[c] for c in columns]) for r in df.collect())
    cursor = con.execute(ALL[name].sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert ours == sorted(str([r[names.index(c)] for c in columns]) for r in cursor.fetchall())


@pytest.mark.parametrize("name", list(COUNTED))
def test_every_row(spark, name):
    assert ALL[name].run(spark, SF).count() == spark.read.parquet(f"{SF}/{COUNTED[name]}.parquet").count()
