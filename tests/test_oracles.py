"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if isinstance(v, (list, np.ndarray)):
        return tuple(map(_value, v))
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, (float, np.floating)) and np.isnan(v):
        return None
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer, float, np.floating)):
        return round(float(v), 5) + 0.0
    return v


def rows_of(df: pd.DataFrame) -> list:
    return sorted((tuple(map(_value, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("set timezone='UTC'")
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    found, wanted = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    a, b = rows_of(found), rows_of(wanted)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-5 * max(1, abs(p)) for p, q in zip(x, y, strict=True)), (x, y)
