"""Every registered query against its SQL, at the smallest scale."""

import datetime
import math

import duckdb
import pytest

from trailmark.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Trained models take longest; they run in test_models_run.
MODELS = {"train_classifiers", "feature_importance", "concordance_cv", "kmeans_best_k"}


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value) + 0.0:.4f}".replace("-0.0000", "0.0000")
    if isinstance(value, datetime.datetime):
        return str(value.replace(tzinfo=None))
    return str(value)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_query_matches_sql(name, spark, duck):
    got = QUERIES[name](spark, DIR)
    names = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert names == sorted(want.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    at = [want.columns.index(c) for c in names]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - MODELS))
def test_query_without_sql_runs(name, spark):
    assert QUERIES[name](spark, DIR).count() > 0
