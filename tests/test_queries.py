"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import numpy as np
import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _names():
    from tidemark.queries import QUERIES

    return sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def _normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else v)
    return df.sort_values(list(df.columns), ignore_index=True, na_position="first")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, duck, name):
    from tidemark.queries import QUERIES, SQL

    ours = _normal(QUERIES[name](spark, DATA).toPandas())
    if name not in SQL:
        assert len(ours)
        return
    theirs = _normal(duck.execute(SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    for c in ours:
        x, y = ours[c], theirs[c]
        assert (pd.isna(x) == pd.isna(y)).all(), c
        keep = ~pd.isna(x)
        if pd.api.types.is_numeric_dtype(x) and pd.api.types.is_numeric_dtype(y):
            assert np.allclose(x[keep].astype(float), y[keep].astype(float), rtol=0, atol=2e-6), c
        else:
            assert (x[keep].astype(str) == y[keep].astype(str)).all(), c
