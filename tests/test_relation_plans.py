"""Blocked products and superset counts: values against plain versions, and what their plans read and shuffle."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import relations


def _frame(spark, X):
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in X]
    return spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(X.shape[1]))).repartition(5)


@pytest.mark.parametrize("k,block,size", [(3, 256, 32 << 20), (23, 4, 2000)])
def test_correlation_of_any_number_of_columns(spark, monkeypatch, k, block, size):
    monkeypatch.setattr(relations, "GRAM_BLOCK", block)
    monkeypatch.setattr(relations, "GRAM_BYTES", size)
    rng = np.random.default_rng(k)
    X = rng.normal(size=(5000 if k == 3 else 300, k)) + 1e6
    X[:, 1] += 3 * X[:, 0]
    X[rng.random(X.shape) < 0.2] = np.nan
    X[:, 2] = 0.1  # constant
    if k > 3:
        X[:, 4] = np.nan
        X[:, 5] = np.where(np.arange(len(X)) % 2, 7.3, np.nan)  # constant where it is
        X[:, 6] = np.where(np.arange(len(X)) % 2, np.nan, X[:, 6])  # never with c5
    got = {(r["col1"], r["col2"]): (r["corr"], r["n"]) for r in relations.corr_pairs(_frame(spark, X)).collect()}
    assert list(got) and set(got) == {(f"c{a}", f"c{b}") for a, b in combinations(range(k), 2)}
    for a, b in combinations(range(k), 2):
        both = ~np.isnan(X[:, a]) & ~np.isnan(X[:, b])
        x, y = X[both, a], X[both, b]
        r, n = got[f"c{a}", f"c{b}"]
        assert n == both.sum()
        if n < 2 or np.ptp(x) == 0 or np.ptp(y) == 0:
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-7)
    full = {(r["col1"], r["col2"]): r["corr"] for r in relations.corr_matrix(_frame(spark, X), ndigits=None).collect()}
    assert len(full) == k * k
    assert all(full[a, b] == full[b, a] for a, b in full)
    assert full["c0", "c0"] == 1.0 and full["c2", "c2"] is None
    if k > 3:
        assert full["c4", "c4"] is None


def test_correlation_scans_and_products(spark):
    """One scan for shifts and one for products at any width; the products' partial sums are at most pairs x tasks."""
    wide = spark.range(2000).select(*[(F.rand(j) + j).alias(f"c{j}") for j in range(60)]).repartition(3)
    pairs = relations._gram(wide, wide.columns)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Expand" not in plan
    assert pairs.count() == 60 * 61 // 2
    assert relations._gram(wide, wide.columns).filter("n <> 2000").count() == 0


@pytest.mark.parametrize("sizes", [[2, 3, 4], [3, 10**9, 10**9, 2], [10, 20, 30, 40, 50, 60], [5], [], [40_000, 40_000]])
def test_supersets_cover_every_pair(sizes):
    sets = relations.supersets(sizes, 50_000)
    pairs = set(combinations(range(len(sizes)), 2))
    assert {p for s in sets for p in combinations(s, 2)} == pairs
    assert all(len(s) == 2 or np.prod([float(sizes[c]) for c in s]) <= 50_000 for s in sets)
    if sizes == [2, 3, 4]:
        assert sets == [(0, 1, 2)]


def _chi2(rows, a, b, correction=True):
    o = Counter((r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None)
    ra, cb = Counter(), Counter()
    for (x, y), n in o.items():
        ra[x] += n
        cb[y] += n
    n, dof = sum(o.values()), (len(ra) - 1) * (len(cb) - 1)
    s = 0.0
    for x in ra:
        for y in cb:
            e = ra[x] * cb[y] / n
            d = abs(o.get((x, y), 0) - e)
            s += (d - (min(0.5, d) if dof == 1 else 0)) ** 2 / e
    return s, dof, n


def test_chi_square_shuffles_cells_of_pairs_not_combinations(spark):
    """Six columns of 12 values have near-unique joint combinations; what the count by sets of columns hands on stays small."""
    rng = np.random.default_rng(3)
    V = rng.integers(0, 12, (6000, 6))
    V[:, 1] = np.where(rng.random(6000) < 0.5, V[:, 0], V[:, 1])
    rows = [[None if rng.random() < 0.05 else f"v{x}" for x in r] for r in V] + [["v1", None, "w", "w", None, None]]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} string" for j in range(6))).repartition(4)
    counts, sets = relations._superset_counts(df, df.columns)
    joint = df.distinct().count()
    per_set = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert joint > 5000
    for s, cols in enumerate(sets):
        assert per_set[s] <= np.prod([14.0] * len(cols))
        assert 14.0 ** len(cols) <= relations.SUPERSET_CELLS or len(cols) == 2
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
    got = {(r["col1"], r["col2"]): (r["chi2"], r["dof"], r["n"]) for r in relations.chi_square(df).collect()}
    assert len(got) == 15
    for a, b in combinations(range(6), 2):
        want = _chi2(rows, a, b)
        assert got[f"c{a}", f"c{b}"] == pytest.approx(want, rel=1e-9)


def test_correlation_with_infinite_values_is_null(spark):
    df = spark.createDataFrame([(1.0, float("inf"), 1.0), (2.0, 1.0, 3.0), (3.0, 2.0, 4.0)], "a double, b double, c double")
    got = {(r["col1"], r["col2"]): r["corr"] for r in relations.corr_matrix(df).collect()}
    assert got["a", "c"] == got["c", "a"] == 0.982 and got["a", "a"] == 1.0
    assert all(got[x] is None for x in got if "b" in x)
