"""Every query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (list, dict)):
        return str(value)
    if value is None or pd.isna(value):
        return None
    if isinstance(value, float):
        value = round(value, 6) + 0.0
        return int(value) if math.isfinite(value) and value == int(value) else value
    if hasattr(value, "year"):
        return str(value)[:10]
    return value.item() if hasattr(value, "item") else value


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str(tuple(map(plain, r))) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(name, spark, sf_dir, duck):
    columns, got = rows(catalogue.QUERIES[name](spark, sf_dir).toPandas())
    expected_columns, expected = rows(duck.sql(catalogue.ORACLE_SQL[name]).df())
    assert columns == expected_columns
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(name, spark, sf_dir):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["coordination_clusters", "coordination_report", "embedding_leaders"])
def test_clusters_form_no_pairs(name, spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalogue.networks, "similarity_edges", lambda *a, **k: pytest.fail("pairs grow with the square of the rows"))
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
