"""Every query of the library against its SQL counterpart, at two scales; those without SQL run and have rows."""

import math

import duckdb
import pandas as pd
import pytest

from boutlens.plans.catalog import QUERIES, SQL

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: no rows at the smallest scale
SPARSE = {"crowded_days"}


def connected(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        return plain(value.item())
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)[:26].removesuffix(" 00:00:00")


def rows(df):
    df = df[sorted(df.columns)]
    own = [tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False, name=None)]
    return sorted(own, key=lambda r: [(v is None, str(type(v)), round(v, 4) if isinstance(v, float) else v) if v is not None else (True, "", 0) for v in r])


def agree(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1.1e-9)) for x, y in zip(a, b))


def compare(spark, name, sf_dir):
    con = connected(sf_dir)
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) and (len(want) or name in SPARSE)
    wrong = [(a, b) for a, b in zip(rows(got), rows(want)) if not agree(a, b)]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    compare(spark, name, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["odds_devig", "division_rate_asof", "ewma_before", "career_snapshot", "pair_match", "travel_features", "odds_features", "differential_matrix_core", "asof_backward_event", "crowded_days"])
def test_query_at_ten_times_the_rows(spark, name):
    compare(spark, name, "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, name):
    out = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) and out.columns.is_unique
