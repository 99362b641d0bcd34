"""Every query with SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import duckdb
import pytest

from slopewatch.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(0.0 if v == 0 else v)
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees(spark, data, oracle, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    relation = oracle.sql(SQL[name])
    assert sorted(relation.columns) == cols
    at = [relation.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 25 and "indice_riesgo" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rows_only_queries(spark, data):
    assert QUERIES["approx_users"](spark, data).count() == 5
    rows = QUERIES["train_predict"](spark, data).collect()
    assert len(rows) == 500 and all(0 <= r.risk_score <= 1 for r in rows)


def test_boosted_trees_on_a_rare_class(spark, data):
    rows = QUERIES["train_boosted"](spark, data).collect()
    mean = {y: sum(r.risk_score for r in rows if r.label == y) / sum(r.label == y for r in rows) for y in (0, 1)}
    assert len(rows) == 500 and mean[1] > mean[0]


def test_refusals_are_sought_in_whole_texts(spark, data):
    assert "left(" not in QUERIES["refusal_flag"](spark, data)._jdf.queryExecution().analyzed().toString().lower()
