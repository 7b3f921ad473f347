import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from trackloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple("NULL" if pd.isna(x) else str(x) if isinstance(x, str) else float(x) for x in t) for t in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 7
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
