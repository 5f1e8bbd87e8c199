"""Every query of the engine with an oracle gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from textloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{round(float(v), 5) + 0.0:.5f}".rstrip("0").rstrip(".")
    return str(v)


def same_rows(spark, sf_dir, name, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql)
    cols = [c[0] for c in want.description]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(cols), name
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    right = sorted(tuple(normal(r[k]) for k in order) for r in want.fetchall())
    left = sorted(tuple(normal(r[c]) for c in sorted(cols)) for r in df.collect())
    assert left == right, name


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    same_rows(spark, sf_dir, name, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_queries_without_oracle_run(spark, sf_dir):
    for name in catalogue.queries().keys() - catalogue.oracle_sql().keys():
        assert catalogue.queries()[name](spark, sf_dir).count() > 0, name


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
