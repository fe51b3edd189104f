"""Every registered cut-off query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from cutpoint.oracles import oracle_sql
from cutpoint.queries import queries

SQL = oracle_sql()


def rows(table, columns):
    return sorted(repr(tuple(None if x != x else x for x in r)) for r in table[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "documents", "labels", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf_dir, tables, name):
    got = queries()[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(got) == 1
        return
    expected = tables.execute(SQL[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(expected, columns)


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(SQL) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scan_reads_two_columns(spark, sf_dir):
    plan = queries()["class_counts_by_score"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_discount:double>" in plan
