"""Every registered series query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quantframe.jobs import registry

TABLES = "customer events lineitem nation orders part region supplier documents".split()


def plain(value):
    if pd.isna(value):
        return ""
    if isinstance(value, (float, int)) and not isinstance(value, bool):
        return f"{float(value) + 0.0:.6g}".replace("-0", "0") if value == 0 else f"{float(value):.6g}"
    return str(value)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf_dir, db, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = db.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = [sorted(tuple(map(plain, r)) for r in x[columns].itertuples(index=False)) for x in (got, want)]
    assert rows[0] == rows[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.ORACLES) <= set(__spark_entry__.oracle_sql())
