"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import numpy as np
import pytest

import sonagrid.queries as signal_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(signal_queries.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = signal_queries.queries()[name](spark, SF).toPandas()
    sql = signal_queries.oracle_sql().get(name)
    if sql is None:
        # maps: a power for each point of each array, none of them negative, and every array has a loudest point
        assert np.isfinite(got.power).all() and (got.power > -1e-6).all()
        assert got.groupby("array_id").pid.nunique().eq(64).all() and got.groupby("array_id").power.max().gt(0).all()
        return
    want = duck.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    different = ((got != want) & ~(got.isna() & want.isna())).any(axis=1)
    assert not different.any(), (got[different].head(), want[different].head())


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).take(1)) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
