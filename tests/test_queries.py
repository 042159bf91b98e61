"""Each query of the library against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from lumenfold.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(map(tuple, frame[cols].astype(object).where(frame[cols].notna(), None).map(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
