"""Every registered measurement query against its SQL counterpart in DuckDB."""

import decimal
import math

import duckdb
import pandas as pd
import pytest

from calibron.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float | decimal.Decimal):
            return float(v) + 0.0
        return v.item() if hasattr(v, "item") else v

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, sf_dir, name):
    got = catalogue.queries()[name](spark, sf_dir).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    board = __spark_entry__.entry(spark)
    assert board.columns == ["model", "n_items", "accuracy", "theta", "se", "rank"] and board.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
