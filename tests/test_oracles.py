"""Queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from cataloom.jobs import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: All but one that builds a graph twice and takes a minute.
CHOSEN = sorted(set(registry.ORACLE_SQL) - {"s8_subset"})


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    show = lambda v: "none" if pd.isna(v) else (f"{v:.6g}" if isinstance(v, float) else str(v))
    return list(frame.columns), sorted(tuple(map(show, r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return out


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(registry.ORACLE_SQL[name]).df())


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
