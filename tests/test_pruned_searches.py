"""Exactness, pruning and memory of KNN imputation and vector retrieval."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import knn, retrieval




def _clustered(n, nf, seed, gaps=0.15, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 100, (clusters, nf))
    X = centres[rng.integers(0, clusters, n)] + rng.normal(0, 1, (n, nf))
    X[rng.random((n, nf)) < gaps] = np.nan
    X[:, 0] = np.where(np.isnan(X[:, 0]), 0.0, X[:, 0])
    return X


def _frame(spark, X):
    nf = X.shape[1]
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(X)]
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"f{j} double" for j in range(nf))).repartition(4), [f"f{j}" for j in range(nf)]


def _brute(X, k):
    """Row by row, ties by row number."""
    n, nf = X.shape
    out = X.copy()
    for i, j in zip(*np.nonzero(np.isnan(X))):
        both = ~np.isnan(X[i]) & ~np.isnan(X)
        c = both.sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            d2 = np.where(c > 0, np.where(both, X - X[i], 0.0).__pow__(2).sum(axis=1) * nf / c, np.inf)
        donors = np.flatnonzero(~np.isnan(X[:, j]))
        top = donors[np.lexsort((donors, d2[donors]))][:k]
        out[i, j] = np.nanmean(X[:, j]) if not len(top) or d2[top[0]] == np.inf else X[top, j].mean()
    return out


@pytest.mark.parametrize("cell_rows,patterns,chunk_rows,block_rows", [(20, 32, 20_000, 20_000), (10, 3, 15, 9), (1024, 32, 7, 5)])
def test_knn_with_many_cells_patterns_chunks_and_blocks(spark, monkeypatch, cell_rows, patterns, chunk_rows, block_rows):
    monkeypatch.setattr(knn, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(knn, "PATTERNS", patterns)
    X = _clustered(240, 4, cell_rows, gaps=0.3)
    X[5] = np.nan  # nothing to compare with
    X[17, 1:] = np.nan
    X[30:40] = X[30]  # ties
    X[30, 2] = np.nan
    df, cols = _frame(spark, X)
    got = knn.impute_knn(df, "k", k=4, columns=cols, chunk_rows=chunk_rows, block_rows=block_rows).orderBy("k").select(*cols).collect()
    np.testing.assert_allclose(np.array(got, dtype=float), _brute(X, 4), rtol=1e-9, atol=1e-9)


def test_knn_prunes_clustered_rows(spark):
    df, cols = _frame(spark, _clustered(12_000, 3, 1))
    done, full = knn.evaluations(df, "k", k=5, columns=cols)
    assert 0 < done < full / 4, (done, full)


def test_cells_bounds_hold(spark):
    """No donor among the k nearest lies in a cell that is left out."""
    rng = np.random.default_rng(4)
    X = _clustered(400, 3, 9, gaps=0.25)
    cell = rng.integers(0, 30, 400)
    masks = ~np.isnan(X)
    kinds = {m.tobytes(): i for i, m in enumerate(np.unique(masks, axis=0))}
    cell = np.array([kinds[m.tobytes()] * 30 + c if kinds[m.tobytes()] else len(kinds) * 30 + c % 3 for m, c in zip(masks, cell)])  # one pattern is in mixed cells
    cell[masks.sum(axis=1) == 2] = len(kinds) * 30 + 4
    size = len(kinds) * 30 + 30
    with np.errstate(invalid="ignore"):
        lo = np.array([np.nanmin(np.vstack([X[cell == c], np.full(3, np.nan)]), axis=0) for c in range(size)])
        hi = np.array([np.nanmax(np.vstack([X[cell == c], np.full(3, np.nan)]), axis=0) for c in range(size)])
    cells = knn.Cells(np.bincount(cell, minlength=size), ~np.isnan(lo), np.arange(size) >= len(kinds) * 30, np.nan_to_num(lo), np.nan_to_num(hi))
    need = cells.needed(X, 5)
    for i, j in zip(*np.nonzero(np.isnan(X))):
        both = masks[i] & masks
        c = both.sum(axis=1)
        d2 = np.where(c > 0, (np.where(both, X - X[i], 0.0) ** 2).sum(axis=1) * 3 / np.maximum(c, 1), np.inf)
        donors = np.flatnonzero(masks[:, j])
        for d in donors[np.lexsort((donors, d2[donors]))][:5]:
            assert need[i, cell[d]]


def test_knn_step_memory():
    """A full block meets a full chunk of 8 features in bounded steps."""
    rng = np.random.default_rng(0)
    D = rng.normal(size=(knn.CHUNK_ROWS, 8))
    R = rng.normal(size=(512, 8))
    R[:, 3] = np.nan
    tracemalloc.start()
    out = knn._partial_topk(R, np.arange(512), D, np.arange(len(D)), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 512 * 5
    assert peak < 200e6, peak


def _brute_topk(V, vids, Q, qids, k):
    out = {}
    for q, i in zip(Q, qids):
        s = V @ (q / np.linalg.norm(q)) / np.linalg.norm(V, axis=1)
        out[i] = [(int(vids[j]), s[j]) for j in np.lexsort((vids, -s))[:k]]
    return out


@pytest.mark.parametrize("cells,block,chunk", [(256, 4096, 16_384), (40, 7, 30), (1, 3, 50)])
def test_vector_topk_with_many_cells(spark, monkeypatch, cells, block, chunk):
    monkeypatch.setattr(retrieval, "CELL_ROWS", 10)
    rng = np.random.default_rng(cells)
    centres = rng.normal(size=(8, 12))
    V = centres[rng.integers(0, 8, 500)] + rng.normal(0, 0.1, (500, 12))
    V[60:70] = V[60] * 2  # equal directions: ties by id
    vids = rng.permutation(500)
    vd = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(vids, V)], "vec_id long, embedding array<double>").repartition(4)
    asked = V[::25] + 0.01
    asked[0] = V[60]
    qd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "qid long, qvec array<double>")
    want = _brute_topk(V, vids, asked, range(len(asked)), 6)
    got = {}
    for r in retrieval.top_k(vd, qd, k=6, cells=cells, block_rows=block, chunk_rows=chunk).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for q, hits in want.items():
        np.testing.assert_allclose([s for _, s in got[q]], [s for _, s in hits], atol=1e-12)
        if q:  # rounding decides among equal directions
            assert [i for i, _ in got[q]] == [i for i, _ in hits]
    if cells == 256:
        assert retrieval.evaluations(vd, qd, k=6, cells=cells) < len(asked) * 500 / 3


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    vd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 1.0]), (7, [1.0, 1.0]), (8, [1.0])],
                               "vec_id long, embedding array<double>")
    qd = spark.createDataFrame([(1, [1.0, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [2.0]), (5, [1.0, 1.0, 1.0])], "qid long, qvec array<double>")
    got = [(r["qid"], r["rank"], r["vec_id"]) for r in retrieval.top_k(vd, qd, k=5).orderBy("qid", "rank").collect()]
    assert got == [(1, 1, 7), (1, 2, 1), (4, 1, 8)]
    assert retrieval.top_k(vd.limit(0), qd).count() == 0 and retrieval.top_k(vd, qd.limit(0)).count() == 0
    assert retrieval.top_k(vd.select("*", F.lit(1).alias("cell"), F.lit(2).alias("v")), qd, k=1).count() == 2
