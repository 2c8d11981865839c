"""Every registered query against its DuckDB oracle at sf0.001 (the driver's
gate runs at sf0.01; a second scale catches data-dependent slips), plus a
row-count smoke run of the rows-only keys."""

import math
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from tablelens.plans.fixtures import TABLES

from conftest import SF_SMALL

# the training-data operators have tests of their own (tests/llm)
_Q, _O = ({k: v for k, v in x.items() if not re.match(r"op\d+_|pipeline$", k)} for x in (E.queries(), E.oracle_sql()))


def _norm(v):
    import numpy as np
    if v is None:
        return None
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, np.ndarray):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    return v


def _sort_key(row):
    # floats coarsened only for ordering; values are compared with tolerance
    return repr(tuple(round(x, 2) if isinstance(x, float) else x for x in row))


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=_sort_key)


def _same(a, b):
    """Equal, or floats within one unit of the 4th decimal: Spark rounds
    half-up on the decimal form, DuckDB on the binary double, so an exact
    tie (e.g. a mean of 38.37875) may round apart by 1e-4."""
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.0001e-4)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_same(x, y) for x, y in zip(a, b))
    return a == b


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(_O))
def test_matches_duckdb(spark, duck, key):
    got = _Q[key](spark, SF_SMALL).toPandas()
    exp = duck.execute(_O[key]).df()
    c1, r1 = _rows(got)
    c2, r2 = _rows(exp)
    assert c1 == c2
    assert len(r1) == len(r2)
    bad = [(a, b) for a, b in zip(r1, r2) if not _same(a, b)]
    assert not bad, bad[:3]


@pytest.mark.parametrize("key", sorted(set(_Q) - set(_O)))
def test_rows_only_keys_run(spark, key):
    assert _Q[key](spark, SF_SMALL).count() >= 0


def test_entry_smoke(spark):
    out = E.entry(spark)
    assert out.columns[:2] == ["column", "count"] and out.count() == 8
