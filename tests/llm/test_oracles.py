"""Operators that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from ledgerloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, sf_dir), con.execute(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    names = sorted(ours.columns)
    got, wanted = ([tuple(str(x) for x in row) for row in frame[names].itertuples(index=False)] for frame in (ours.toPandas(), theirs))
    assert got and sorted(got) == sorted(wanted)
