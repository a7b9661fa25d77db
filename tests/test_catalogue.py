"""Each query against its SQL, over whole tables of the smallest size."""

import datetime

import duckdb
import pandas as pd
import pytest

from tallyloom.plans import catalogue

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v != v:
            return "null"
        if isinstance(v, (datetime.date, pd.Timestamp)):
            return str(v)[:10]
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return repr(round(float(v), 5) + 0.0)
        return str(v)

    return sorted(tuple(map(one, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), db.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["document_id", "label_id", "date", "document_type"]
