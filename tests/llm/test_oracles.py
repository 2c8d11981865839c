"""Queries with SQL against DuckDB at sf0.001, value by value."""

import duckdb
import pytest

from tablelens.llm.registry import ORACLE, QUERIES

from .conftest import SF


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_duckdb(spark, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    exp = con.execute(ORACLE[key])
    names = [d[0] for d in exp.description]
    got = QUERIES[key](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(exp.fetchall())
