"""Every registered reference query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tissuequery.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in ("embeddings", "events", "lineitem", "part"):
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    return sorted((tuple(None if pd.isna(v) else round(float(v), 5) + 0.0 if isinstance(v, float) else v for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, float) and abs(p - q) < 2e-5 for p, q in zip(x, y)), (x, y)


def test_all_queries_are_covered():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) <= {"moran_p", "lasso_fit", "train_all", "train_with_priors"}
