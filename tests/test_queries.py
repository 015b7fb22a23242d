"""Every registered query with an oracle against DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from trustloom.plans.registry import ORACLES, QUERIES
from trustloom.plans.views import TABLES


def _rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str(list(v))
        if pd.isna(v):
            return None
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf, duck, name):
    assert _rows(QUERIES[name](spark, sf).toPandas()) == _rows(duck.sql(ORACLES[name]).df())
