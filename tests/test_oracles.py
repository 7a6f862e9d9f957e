"""Every ledger query against its DuckDB oracle on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from ledgerloom import queries as ledger


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (datetime.date, pd.Timestamp)):
        return str(x)[:19].removesuffix(" 00:00:00")
    if type(x).__name__ in ("bool", "bool_"):
        return bool(x)
    return x if isinstance(x, str) else int(x)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ledger.ORACLES))
def test_against_duckdb(spark, sf_dir, duck, name):
    ours, theirs = ledger.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ledger.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
