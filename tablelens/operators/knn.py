"""K-nearest-neighbour imputation of numeric columns, exact, with metric pruning.

Semantics (the reference's imputer): every numeric column is a feature;
distance between two rows uses only coordinates present in both, scaled by
(all features / present features); for each missing cell, donors are rows
that have that feature, the ``k`` nearest are averaged (uniform weights);
a row with no comparable donor gets the column mean.  Ties in distance are
broken by the row key, so the result is deterministic.

Plan:

1. rows are put into cells: their missing pattern and the nearest of a few
   pivots (rows picked by hash).  One aggregate gives each cell's count and
   bounding box; there are at most ``CELLS`` cells, whatever the rows;
2. for each row with a gap ("receiver") and missing feature, the boxes bound
   its distance to a cell's rows over the coordinates that both patterns
   have: from the upper bounds, cells that together hold ``k`` donors give a
   distance within which ``k`` donors lie, and only cells whose lower bound is
   not beyond it can hold one of the nearest;
3. a cell's rows are dealt into chunks, and the receivers that need the cell
   into blocks; each (block, chunk) meets in one task by a cogroup, which
   goes through both in steps of fixed size and keeps a top-k per
   (receiver, feature).  No pair rows are made, nothing but the boxes passes
   the driver, and a task holds one block and one chunk;
4. partial lists merge in a ``row_number() <= k``.

Nothing is approximate: a cell is left out only where its box proves that
it holds none of the k nearest.  On data without structure the boxes prove
little and every receiver meets every chunk, which is what exact KNN costs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import numeric_columns, present, validate
from tablelens.session import ship_package, written

# Rows of one block and one chunk: what a task holds.
BLOCK_ROWS = 20_000
CHUNK_ROWS = 20_000
#: Cells in all, missing patterns told apart (rarer ones are one class), rows a cell should hold at least.
CELLS, PATTERNS, CELL_ROWS = 1024, 32, 1024
#: Receivers and rows that one step of a meeting compares.
STEP_RECEIVERS, STEP_ROWS = 256, 4096
CANDIDATE_SCHEMA = "rk long, f int, dk long, d2 double, v double"

_NO_KEY = np.iinfo(np.int64).max
#: Bounds are sums in another order than distances: they are widened by this share.
_SLACK = 1e-9


def distances(R: np.ndarray, D: np.ndarray, shared: np.ndarray, nf: int) -> np.ndarray:
    """Scaled squared distances of all pairs over the ``shared`` features, summed feature by feature."""
    if len(shared) == 0:
        return np.full((len(R), len(D)), np.inf)
    sq = np.zeros((len(R), len(D)))
    for j in shared:
        diff = np.subtract.outer(R[:, j], D[:, j])
        diff *= diff
        sq += diff
    sq *= nf
    sq /= len(shared)
    return sq


def _nearest(d2: np.ndarray, keys: np.ndarray, k: int):
    """(distance, column) of each row's ``k`` nearest, ties by key; columns of -1 where there are fewer."""
    n, m = d2.shape
    kk = min(k, m)
    at = np.argpartition(d2, kk - 1, axis=1)[:, :kk] if kk < m else np.broadcast_to(np.arange(m), (n, m)).copy()
    dist = np.take_along_axis(d2, at, axis=1)
    kth = dist.max(axis=1)
    for i in np.flatnonzero((d2 <= kth[:, None]).sum(axis=1) > kk):  # ties at the border: exact order by key
        sel = np.flatnonzero(d2[i] <= kth[i])
        at[i] = sel[np.lexsort((keys[sel], d2[i, sel]))[:kk]]
        dist[i] = d2[i, at[i]]
    return dist, at


def _patterns(X: np.ndarray):
    """(present features, rows) of each missing pattern in X."""
    masks, of = np.unique(~np.isnan(X), axis=0, return_inverse=True)
    of = of.ravel()
    return [(m, np.flatnonzero(of == i)) for i, m in enumerate(masks)]


def _partial_topk(R: np.ndarray, rkeys: np.ndarray, D: np.ndarray, dkeys: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` nearest donors of D for each (receiver, missing feature), ties by donor key."""
    nf = R.shape[1]
    out = []
    donors = _patterns(D)
    for rmask, rrows in _patterns(R):
        missing = np.flatnonzero(~rmask)
        for s in range(0, len(rrows), STEP_RECEIVERS):
            rows = rrows[s:s + STEP_RECEIVERS]
            best_d = np.full((len(missing), len(rows), k), np.inf)
            best_k = np.full((len(missing), len(rows), k), _NO_KEY, dtype="int64")
            best_v = np.full((len(missing), len(rows), k), np.nan)
            for dmask, drows in donors:
                gives = np.flatnonzero(dmask[missing])
                shared = np.flatnonzero(rmask & dmask)
                for t in range(0, len(drows) if len(gives) else 0, STEP_ROWS):
                    cols = drows[t:t + STEP_ROWS]
                    dist, at = _nearest(distances(R[rows], D[cols], shared, nf), dkeys[cols], k)
                    key = dkeys[cols][at]
                    for g in gives:  # one pattern: the same donors for every feature
                        md = np.concatenate([best_d[g], dist], axis=1)
                        mk = np.concatenate([best_k[g], key], axis=1)
                        mv = np.concatenate([best_v[g], D[cols, missing[g]][at]], axis=1)
                        order = np.lexsort((mk, md), axis=1)[:, :k]
                        best_d[g], best_k[g], best_v[g] = (np.take_along_axis(x, order, axis=1) for x in (md, mk, mv))
            g, r, _ = np.nonzero(best_k != _NO_KEY)
            real = best_k != _NO_KEY
            out.append((rkeys[rows][r], missing[g].astype("int32"), best_k[real], best_d[real], best_v[real]))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
    return pd.DataFrame(dict(zip(("rk", "f", "dk", "d2", "v"), cols, strict=True)))


class Cells:
    """Count, present features and bounding box of each cell; ``mixed`` cells hold several patterns."""

    def __init__(self, count, has, mixed, lo, hi):
        self.count, self.has, self.mixed, self.lo, self.hi = count, has, mixed, lo, hi

    def needed(self, R: np.ndarray, k: int) -> np.ndarray:
        """(receivers, cells): may the cell hold one of the ``k`` nearest donors of a missing feature?"""
        n, nf = R.shape
        present_in = ~np.isnan(R)
        low, high, least = np.zeros((3, n, len(self.count)))
        least[:] = np.inf
        shared = np.zeros((n, len(self.count)), int)
        for j in range(nf):
            both = present_in[:, j][:, None] & self.has[:, j][None, :]
            x = np.where(present_in[:, j], R[:, j], 0.0)[:, None]
            below, above = self.lo[:, j][None, :] - x, x - self.hi[:, j][None, :]
            gap, reach = np.maximum(np.maximum(below, above), 0.0) ** 2, np.maximum(np.abs(below), np.abs(above)) ** 2
            low += np.where(both, gap, 0.0)
            high += np.where(both, reach, 0.0)
            least = np.where(both, np.minimum(least, gap), least)
            shared += both
        none = shared == 0
        scale = nf / np.maximum(shared, 1)
        # which coordinates a mixed cell's row shares is open: their mean is at least the least of them
        low = np.where(none, np.inf, np.where(self.mixed[None, :], least * nf, low * scale))
        low = np.where(self.mixed[None, :] & none, 0.0, low)
        high = np.where(none | self.mixed[None, :], np.inf, high * scale)
        out = np.zeros((n, len(self.count)), bool)
        for j in np.flatnonzero(~present_in.all(axis=0)):
            rows = np.flatnonzero(~present_in[:, j])
            cells = np.flatnonzero(self.has[:, j])
            if len(cells) == 0:
                continue
            up = high[np.ix_(rows, cells)]
            order = np.argsort(up, axis=1)
            enough = np.cumsum(self.count[cells][order], axis=1) >= k
            at = np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1)
            bound = np.where(enough[:, -1], np.take_along_axis(up, at, axis=1)[:, 0], np.inf)
            bound = bound * (1 + _SLACK) + 1e-300
            out[np.ix_(rows, cells)] |= low[np.ix_(rows, cells)] * (1 - _SLACK) <= bound[:, None]
        return out


def _matrix(batch, nf: int) -> np.ndarray:
    cols = [batch.column(f"x{j}").to_numpy(zero_copy_only=False) for j in range(nf)]
    return np.stack(cols, axis=1).astype("float64") if cols else np.zeros((batch.num_rows, 0))


def _celled(data: DataFrame, nf: int, k: int, means: list[float], n_rows: int) -> tuple[DataFrame, Cells]:
    """``data`` (written) with its ``cell`` number, and the cells."""
    mask = F.concat(*[F.when(F.col(f"x{j}").isNull(), "0").otherwise("1") for j in range(nf)])
    data = data.withColumn("mask", mask)
    kinds = [r["mask"] for r in data.groupBy("mask").count().orderBy(F.desc("count"), "mask").limit(PATTERNS - 1).collect()]
    pivots = max(1, min(CELLS // (len(kinds) + 1), math.ceil(n_rows / CELL_ROWS)))
    picked = data.orderBy(F.xxhash64("__key"), "__key").limit(pivots).collect()
    P = np.array([[means[j] if r[f"x{j}"] is None else r[f"x{j}"] for j in range(nf)] for r in picked], dtype="float64").reshape(-1, nf)
    P = np.nan_to_num(P)

    def assign(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(s, STEP_ROWS)
                X = _matrix(part, nf)
                d = np.zeros((len(X), len(P)))
                for j in range(nf):
                    diff = np.nan_to_num(X[:, j][:, None] - P[None, :, j])
                    d += diff * diff
                kind = np.array([kinds.index(m) if m in kinds else len(kinds) for m in part.column("mask").to_pylist()], dtype="int64")
                cell = kind * len(P) + d.argmin(axis=1)
                keep = [part.column(i) for i, c in enumerate(part.schema.names) if c != "mask"]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(cell.astype("int32"))], [*[c for c in part.schema.names if c != "mask"], "cell"])

    fields = [f for f in data.schema.fields if f.name != "mask"]
    out = written(data.mapInArrow(assign, T.StructType([*fields, T.StructField("cell", T.IntegerType())])), "knn-rows")
    boxes = out.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(f"x{j}").alias(f"{name}{j}") for j in range(nf) for f, name in ((F.min, "lo"), (F.max, "hi"))])
    rows = {r["cell"]: r for r in boxes.collect()}  # at most CELLS
    size = (len(kinds) + 1) * len(P)
    count, mixed = np.zeros(size, "int64"), np.arange(size) >= len(kinds) * len(P)
    lo, hi = np.full((2, size, nf), np.nan)
    for c, r in rows.items():
        count[c] = r["n"]
        lo[c], hi[c] = ([np.nan if r[f"{b}{j}"] is None else r[f"{b}{j}"] for j in range(nf)] for b in ("lo", "hi"))
    has = ~np.isnan(lo)
    return out, Cells(count, has, mixed, np.nan_to_num(lo), np.nan_to_num(hi))


def _meetings(data: DataFrame, nf: int, k: int, cells: Cells) -> DataFrame:
    """Receivers with the cells that they need, a row each (written)."""
    def match(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, STEP_RECEIVERS):
                part = batch.slice(s, STEP_RECEIVERS)
                r, c = np.nonzero(cells.needed(_matrix(part, nf), k))
                rows = part.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(c.astype("int32"))], rows.schema.names)

    gap = F.lit(False)
    for j in range(nf):
        gap = gap | F.col(f"x{j}").isNull()
    return written(data.filter(gap).mapInArrow(match, data.schema), "knn-receivers")


def _prepared(df: DataFrame, key: str | None, cols: list[str], k: int):
    """(rows with ``__key``, celled data, cells, receivers by cell, column means)."""
    nf = len(cols)
    ship_package(df.sparkSession)
    if key is not None and isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        rows = df.withColumn("__key", F.col(key).cast("long"))
    else:
        # numbered once and written, so that both uses below see the same numbers
        rows = written(df.withColumn("__key", F.monotonically_increasing_id()), "knn-numbered")
    data = rows.select("__key", *[present(df, c).cast("double").alias(f"x{j}") for j, c in enumerate(cols)])
    stats = data.agg(*[F.avg(f"x{j}").alias(f"m{j}") for j in range(nf)], F.count(F.lit(1)).alias("n")).first()
    means = [stats[f"m{j}"] for j in range(nf)]
    celled, cells = _celled(data, nf, k, [m or 0.0 for m in means], stats["n"])
    return rows, celled, cells, _meetings(celled, nf, k, cells), means


def evaluations(df: DataFrame, key: str | None = None, k: int = 5, columns: list[str] | None = None) -> tuple[int, int]:
    """Distances that ``impute_knn`` computes, and those of all receivers with all rows."""
    cols = columns or numeric_columns(df)
    _, celled, cells, meet, _ = _prepared(df, key, cols, k)
    per = {r["cell"]: r["n"] for r in meet.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    gap = F.greatest(*[F.col(f"x{j}").isNull().cast("int") for j in range(len(cols))]) if len(cols) > 1 else F.col("x0").isNull().cast("int")
    receivers = celled.filter(gap == 1).count()
    return sum(n * int(cells.count[c]) for c, n in per.items()), receivers * int(cells.count.sum())


def impute_knn(df: DataFrame, key: str | None = None, k: int = 5, columns: list[str] | None = None,
               block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Fill gaps of the numeric columns from the ``k`` nearest rows; they
    come back as double, other columns untouched.  Distance ties go to the
    smaller ``key`` if an integer column that identifies rows is given, else
    to the earlier row."""
    cols = columns or numeric_columns(df)
    validate(df, key, *cols)
    nf = len(cols)
    if nf == 0:
        return df
    rows, celled, cells, meet, means = _prepared(df, key, cols, k)
    # chunks by cell, and blocks of the receivers that need it: two small arrays
    per = {r["cell"]: r["n"] for r in meet.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = [max(1, math.ceil(int(n) / chunk_rows)) for n in cells.count]
    blocks = [math.ceil(per.get(c, 0) / block_rows) for c in range(len(cells.count))]
    of_cell = lambda numbers: F.array(*[F.lit(n) for n in numbers])[F.col("cell")]
    deal = lambda salt, n: F.pmod(F.xxhash64("__key", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    receivers = meet.select("cell", deal(1, of_cell(blocks)).alias("b"), every(of_cell(chunks)).alias("c"), "__key", *[f"x{j}" for j in range(nf)])
    donors = celled.filter(of_cell(blocks) > 0).select("cell", deal(2, of_cell(chunks)).alias("c"), every(of_cell(blocks)).alias("b"), "__key", *[f"x{j}" for j in range(nf)])

    def met(block, chunk):
        features = [f"x{j}" for j in range(nf)]
        R, D = (x[features].to_numpy(dtype="float64") for x in (block, chunk))
        return _partial_topk(R, block["__key"].to_numpy(dtype="int64"), D, chunk["__key"].to_numpy(dtype="int64"), k)

    group = ["cell", "b", "c"]
    cand = receivers.groupBy(*group).cogroup(donors.groupBy(*group)).applyInPandas(met, CANDIDATE_SCHEMA)
    w = Window.partitionBy("rk", "f").orderBy("d2", "dk")
    top = cand.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k)
    mean = F.array(*[F.lit(m).cast("double") for m in means])
    filled = top.groupBy("rk", "f").agg(
        F.when(F.min("d2") < F.lit(float("inf")), F.avg("v")).otherwise(mean[F.col("f")]).alias("val"))
    wide = filled.groupBy("rk").agg(*[F.max(F.when(F.col("f") == j, F.col("val"))).alias(f"i{j}")
                                      for j in range(nf)])
    joined = rows.join(wide, rows["__key"] == wide["rk"], "left")
    return joined.select(*[
        F.coalesce(present(df, c).cast("double"), F.col(f"i{cols.index(c)}")).alias(c) if c in cols else F.col(c)
        for c in df.columns])
