"""Every query of the library proper against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from veilstone.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows_of(df, columns):
    return sorted(repr(r) for r in df[columns].astype(object).where(df[columns].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    if name not in catalogue.ORACLES:
        assert got.count() > 0
        return
    want = con.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.toPandas(), sorted(got.columns)) == rows_of(want, sorted(want.columns))
