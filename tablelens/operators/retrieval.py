"""Top-k vector retrieval by cosine similarity, exact, with cells that provably can't matter left out.

1. Vectors are scaled to length one and put into cells by their nearest pivot
   (a few rows picked by hash).  One aggregate gives each cell's count and its
   widest angle to the pivot; there are at most ``CELLS`` cells;
2. by Cauchy-Schwarz a unit vector v at angle a from the pivot and a query at
   angle b have a product of at most cos(b - a) and at least cos(b + a).  Cells that
   together hold ``k`` vectors give each query a score that its k-th best
   reaches, and cells whose bound stays below it are skipped;
3. vectors are dealt into chunks and the queries that need a cell into
   blocks; each (block, chunk) meets in one task by a cogroup, which scores in
   steps of fixed size and keeps a top-k per query;
4. partial lists merge in a ``row_number() <= k``.

No query x vector pair rows are made, and only pivots and cell sizes pass the
driver.  Vectors and queries that are null, of length zero, or hold a null or
non-finite component take no part; a query meets the vectors of its own dimension."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.session import ship_package, written

#: Cells at most, vectors a cell should hold at least, and what a task holds.
CELLS, CELL_ROWS = 256, 512
BLOCK_ROWS, CHUNK_ROWS = 4096, 16_384
#: Queries and vectors that one step scores.
STEP_QUERIES, STEP_ROWS = 256, 4096
HIT_SCHEMA = "qid long, vid long, score double"
#: Angles are rounded; bounds are widened by this much.
_SLACK = 1e-6


def _units(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their vectors scaled to length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    X = column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dim)
    with np.errstate(invalid="ignore", over="ignore"):
        size = np.sqrt((X * X).sum(axis=1))
    rows = np.flatnonzero((size > 0) & (size < np.inf))  # NaN, for a null too, is neither
    return rows, X[rows] / size[rows, None]


def _lists(X: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(X) + 1, dtype=np.int32) * X.shape[1]), pa.array(X.ravel()))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def needed(cos_pivot: np.ndarray, count: np.ndarray, width: np.ndarray, k: int) -> np.ndarray:
    """(queries, cells): may the cell hold one of the query's ``k`` best?  ``cos_pivot``: products of
    queries with pivots; ``width``: the cells' widest angles."""
    angle = np.arccos(np.clip(cos_pivot, -1, 1))
    most = np.cos(np.maximum(angle - width, 0)) + _SLACK
    least = np.where(count > 0, np.cos(np.minimum(angle + width, math.pi)) - _SLACK, -np.inf)
    order = np.argsort(-least, axis=1)
    enough = np.cumsum(count[order], axis=1) >= k
    at = np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1)
    reached = np.where(enough[:, -1], np.take_along_axis(least, at, axis=1)[:, 0], -np.inf)
    return (most >= reached[:, None]) & (count > 0)


def _best(Q: np.ndarray, qids: np.ndarray, V: np.ndarray, vids: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's ``k`` highest products, ties by vector id."""
    out = []
    order = np.argsort(vids, kind="stable")
    V, vids = V[order], vids[order]
    for s in range(0, len(Q), STEP_QUERIES):
        q = Q[s:s + STEP_QUERIES]
        best_s, best_i = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), dtype="int64")
        for t in range(0, len(V), STEP_ROWS):
            score = q @ V[t:t + STEP_ROWS].T
            if score.shape[1] > k:  # all that reach the k-th, the first of ties first
                kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                at = np.argsort(-np.where(score >= kth[:, None], score, -np.inf), axis=1, kind="stable")[:, :k]
            else:
                at = np.broadcast_to(np.arange(score.shape[1]), score.shape)
            best_s = np.concatenate([best_s, np.take_along_axis(score, at, axis=1)], axis=1)
            best_i = np.concatenate([best_i, vids[t:t + STEP_ROWS][at]], axis=1)
            keep = np.lexsort((best_i, -best_s), axis=1)[:, :k]
            best_s, best_i = np.take_along_axis(best_s, keep, axis=1), np.take_along_axis(best_i, keep, axis=1)
        out.append((np.repeat(qids[s:s + STEP_QUERIES], best_s.shape[1]), best_i.ravel(), best_s.ravel()))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
    return pd.DataFrame(dict(zip(("qid", "vid", "score"), cols, strict=True)))


class _Plan:
    """Celled vectors and the queries that need each cell, for one dimension."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, dim: int, n: int, k: int, cells: int):
        picked = vectors.orderBy(F.xxhash64("vid"), "vid").limit(max(1, min(cells, math.ceil(n / CELL_ROWS)))).collect()
        P = _units(pa.array([r["v"] for r in picked], pa.list_(pa.float64())), dim)[1]
        if len(P) == 0:
            P = np.eye(1, dim)

        def assign(batches):
            for batch in batches:
                for s in range(0, batch.num_rows, STEP_ROWS):
                    part = batch.slice(s, STEP_ROWS)
                    rows, V = _units(part.column("v"), dim)
                    cos = V @ P.T
                    cell = cos.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("vid").take(pa.array(rows)), _lists(V), pa.array(cell.astype("int32")),
                                                      pa.array(cos[np.arange(len(cell)), cell])], ["vid", "v", "cell", "cos"])

        self.vectors = written(vectors.mapInArrow(assign, "vid long, v array<double>, cell int, cos double"), "vectors")
        self.count, width = np.zeros(len(P), "int64"), np.zeros(len(P))
        for r in self.vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("cos")).collect():  # at most CELLS
            self.count[r["cell"]], width[r["cell"]] = r["n"], math.acos(min(1.0, max(-1.0, r["cos"])))
        count = self.count

        def match(batches):
            for batch in batches:
                for s in range(0, batch.num_rows, STEP_QUERIES):
                    part = batch.slice(s, STEP_QUERIES)
                    rows, Q = _units(part.column("v"), dim)
                    q, cell = np.nonzero(needed(Q @ P.T, count, width, k))
                    yield pa.RecordBatch.from_arrays([part.column("qid").take(pa.array(rows[q])), _lists(Q[q]), pa.array(cell.astype("int32"))], ["qid", "v", "cell"])

        self.queries = written(queries.mapInArrow(match, "qid long, v array<double>, cell int"), "vector-queries")
        self.asked = np.zeros(len(P), "int64")
        for r in self.queries.groupBy("cell").count().collect():
            self.asked[r["cell"]] = r["count"]

    def hits(self, dim: int, k: int, block_rows: int, chunk_rows: int) -> DataFrame:
        chunks = [max(1, math.ceil(int(n) / chunk_rows)) for n in self.count]
        blocks = [math.ceil(int(n) / block_rows) for n in self.asked]
        of_cell = lambda numbers: F.array(*[F.lit(n) for n in numbers])[F.col("cell")]
        deal = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        q = self.queries.select("cell", deal("qid", of_cell(blocks)).alias("b"), every(of_cell(chunks)).alias("c"), "qid", "v")
        v = self.vectors.filter(of_cell(blocks) > 0).select("cell", deal("vid", of_cell(chunks)).alias("c"), every(of_cell(blocks)).alias("b"), "vid", "v")

        def met(block: pa.Table, chunk: pa.Table) -> pa.Table:
            found = pd.DataFrame({"qid": [], "vid": [], "score": []})
            if block.num_rows and chunk.num_rows:
                found = _best(_matrix(block["v"], dim), block["qid"].to_numpy(), _matrix(chunk["v"], dim), chunk["vid"].to_numpy(), k)
            return pa.table({c: pa.array(found[c], t) for c, t in (("qid", pa.int64()), ("vid", pa.int64()), ("score", pa.float64()))})

        group = ["cell", "b", "c"]
        return q.groupBy(*group).cogroup(v.groupBy(*group)).applyInArrow(met, HIT_SCHEMA)


def _plans(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, qid_col: str, qvec_col: str, cells: int):
    """(dimension, plan) for every dimension that queries have."""
    ship_package(vectors.sparkSession)
    q = queries.select(F.col(qid_col).cast("long").alias("qid"), F.col(qvec_col).cast("array<double>").alias("v")).dropna()
    v = vectors.select(F.col(id_col).cast("long").alias("vid"), F.col(vec_col).cast("array<double>").alias("v")).dropna()
    sizes = {r["d"]: r["count"] for r in v.groupBy(F.size("v").alias("d")).count().collect() if r["d"]}
    if len(sizes) > 1:
        asked = {r["d"] for r in q.select(F.size("v").alias("d")).distinct().collect()}
        sizes = {d: n for d, n in sizes.items() if d in asked}
    for dim in sorted(sizes):
        yield dim, _Plan(v.filter(F.size("v") == dim), q.filter(F.size("v") == dim), dim, sizes[dim], k, cells)


def evaluations(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
                qid_col: str = "qid", qvec_col: str = "qvec", cells: int = CELLS) -> int:
    """Products that ``top_k`` computes."""
    return sum(int((p.count * p.asked).sum()) for _, p in _plans(vectors, queries, k, id_col, vec_col, qid_col, qvec_col, cells))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
          vec_col: str = "embedding", qid_col: str = "qid", qvec_col: str = "qvec",
          block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS, cells: int = CELLS) -> DataFrame:
    """``(qid, rank, vec_id, score)``: the ``k`` vectors most cosine-similar
    to each query vector; ties by vector id."""
    spark = vectors.sparkSession
    hits = spark.createDataFrame([], HIT_SCHEMA)
    for dim, plan in _plans(vectors, queries, k, id_col, vec_col, qid_col, qvec_col, cells):
        hits = hits.unionByName(plan.hits(dim, k, block_rows, chunk_rows))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("vid"))
    return (hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("qid", "rank", F.col("vid").alias(id_col), "score"))


def label_centroids(vectors: DataFrame, label: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per label ``(label, qvec)``: posexplode + one grouped
    average; output size is labels x dimensions."""
    ex = vectors.select(label, F.posexplode(vec_col).alias("pos", "x"))
    g = ex.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return g.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))),
                                            lambda s: s["m"]).alias("qvec"))
