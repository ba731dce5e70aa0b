"""The driver's entry points, and every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from boutworks.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows_of(rows, names):
    order = [names.index(n) for n in sorted(names)]

    def value(v):
        return "NaN" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def sql_rows(sql):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found = db.execute(sql)
    return found.fetchall(), [d[0] for d in found.description]


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = catalogue.queries()[name](spark, SF)
    want, names = sql_rows(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(names)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(want, names)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
