"""Hard negatives by Four-Russians scoring.

Vectors become integers, ``floor(scale * x)``.  The index holds each row as packed bit planes: plane b
has bit b (two's complement) of every dimension, eight dimensions to a byte.  An anchor has, for
every group of eight dimensions, a table of the sums of all 256 subsets of its components there.  A plane's
share of the inner product is then the sum of the groups' table entries at the row's bytes, and
doubling and adding from the highest plane down (which counts negatively) gives the exact score.

Anchors are a stated query set against all rows: they are dealt into blocks and the rows into chunks of fixed
size, and each (block, chunk) meets in one task, which scores by tiles and hands on at most
``positives`` rows an anchor in the first pass and ``negatives`` rows an anchor and positive in the second.
Windows merge these lists.  Nothing grows with the table in any task, and nothing passes the driver but four numbers.

Results for odd input: rows with a null id, label or vector, or with a null or non-finite component, take
no part.  Rows repeated in id, label and scaled vector are one row; rows that share an id only are rows of their own,
and anchors of one id each have theirs.  Ties go to the smaller id.  Dimensions that a shorter vector lacks are 0.
Scaled components are cut to +-2**27, so scores fit 64 bits up to 512 dimensions.  An anchor without
positives, or a positive without negatives in its range, has no rows; an empty table gives none.
Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.words import materialise
from tablelens.session import ship_package

SCALE = 256
#: Anchors of a block and rows of a chunk: what one task holds.
BLOCK_ROWS, CHUNK_ROWS = 2048, 4096
#: Anchors and rows that one numpy step scores.
TILE, STEP = 64, 1024
LARGEST = 1 << 27


def scaled(vector: Column, scale: float = SCALE) -> Column:
    """The vector's integers; null if a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    whole = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * float(scale)), F.lit(LARGEST)), F.lit(-LARGEST)))
    return F.when(fine, whole)


def planes_of(values: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes of (rows, 8 x groups) integers."""
    bits = (values[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=-1, bitorder="little")


def values_of(packed: np.ndarray) -> np.ndarray:
    """The integers of packed planes again."""
    bits = np.unpackbits(packed, axis=-1, bitorder="little").astype(np.int64)
    weights = np.int64(1) << np.arange(packed.shape[1], dtype=np.int64)
    weights[-1] = -weights[-1]
    return (bits * weights[None, :, None]).sum(axis=1)


def subset_sums(anchors: np.ndarray, dtype) -> np.ndarray:
    """(groups, 256, anchors): entry m of a group is the sum of the components whose bits are set in m."""
    groups = anchors.shape[1] // 8
    out = np.zeros((groups, 256, len(anchors)), dtype)
    for g in range(groups):
        for i in range(8):
            out[g, 1 << i : 2 << i] = out[g, : 1 << i] + anchors[:, 8 * g + i].astype(dtype)
    return out


def scores(anchors: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors, rows) of integer anchors with packed rows."""
    n, planes, groups = packed.shape
    reach = int(np.abs(anchors).sum(axis=1).max(initial=0))  # no plane's share is beyond it
    small = np.int16 if reach < 1 << 15 else np.int32 if reach < 1 << 31 else np.int64
    wide = np.int32 if reach << planes < 1 << 31 else np.int64
    out = np.empty((len(anchors), n), wide)
    for a in range(0, len(anchors), TILE):
        tables = subset_sums(anchors[a : a + TILE], small)
        width = tables.shape[2]
        for s in range(0, n, STEP):
            at = np.ascontiguousarray(packed[s : s + STEP].transpose(1, 2, 0)).astype(np.intp)
            total = np.zeros((at.shape[2], width), wide)
            share, found = np.empty((2, at.shape[2], width), small)
            for plane in range(planes - 1, -1, -1):
                np.take(tables[0], at[plane, 0], axis=0, out=share, mode="clip")
                for g in range(1, groups):
                    np.take(tables[g], at[plane, g], axis=0, out=found, mode="clip")
                    share += found
                if plane == planes - 1:
                    total -= share
                else:
                    total += total
                    total += share
            out[a : a + TILE, s : s + STEP] = total.T
    return out


def _packed(table: pa.Table, planes: int) -> np.ndarray:
    if table.num_rows == 0:
        return np.zeros((0, planes, 1), np.uint8)
    raw = b"".join(table["packed"].to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(table.num_rows, planes, -1)


def _labels(*tables: pa.Table) -> list[np.ndarray]:
    """Numbers that are equal where labels are."""
    codes = pa.chunked_array([c for t in tables for c in t["label"].chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy()
    return np.split(codes, np.cumsum([t.num_rows for t in tables])[:-1])


def _best(s: np.ndarray, k: int, none) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the k highest scores of each anchor, the first of ties first; overwrites them with ``none``."""
    each, found = np.arange(len(s)), []
    for _ in range(min(k, s.shape[1])):
        j = s.argmax(axis=1)
        v = s[each, j]
        s[each, j] = none
        ok = v > none
        found.append((each[ok], j[ok], v[ok]))
        if not ok.any():
            break
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _positives(planes: int, k: int, schema: pa.Schema):
    """Of one block and one chunk: up to k rows of the anchor's own label, itself left out."""
    def meet(block: pa.Table, chunk: pa.Table) -> pa.Table:
        out = []
        if block.num_rows and chunk.num_rows:
            chunk = chunk.sort_by([("id", "ascending"), ("no", "ascending")])
            rows, ids, numbers = _packed(chunk, planes), chunk["id"].to_numpy(), chunk["no"].to_numpy()
            anchors, mine = values_of(_packed(block, planes)), block["no"].to_numpy()
            of_anchor, of_row = _labels(block, chunk)
            for label in np.intersect1d(of_anchor, of_row):
                a, r = np.flatnonzero(of_anchor == label), np.flatnonzero(of_row == label)
                s = scores(anchors[a], rows[r])
                none = np.iinfo(s.dtype).min
                s[mine[a][:, None] == numbers[r][None, :]] = none
                i, j, v = _best(s, k, none)
                out.append((mine[a][i], ids[r][j], v.astype(np.int64)))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    return meet


def _negatives(planes: int, k: int, low: int, high: int, schema: pa.Schema):
    """Of one block and one chunk: up to k rows of other labels in each positive's range."""
    def meet(block: pa.Table, chunk: pa.Table) -> pa.Table:
        out = []
        if block.num_rows and chunk.num_rows:
            chunk = chunk.sort_by([("id", "ascending"), ("no", "ascending")])
            rows, ids = _packed(chunk, planes), chunk["id"].to_numpy()
            anchors, mine = values_of(_packed(block, planes)), block["no"].to_numpy()
            of_anchor, of_row = _labels(block, chunk)
            lists = block["positives"].combine_chunks()
            counts, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            positive = np.zeros((len(counts), counts.max(initial=0)), np.int64)  # highest first
            there = np.arange(positive.shape[1])[None, :] < counts[:, None]
            positive[there] = flat.field("score").to_numpy()
            for a in range(0, len(anchors), TILE):
                tile = slice(a, a + TILE)
                s = scores(anchors[tile], rows).astype(np.int64)
                none = np.iinfo(np.int64).min
                s[of_anchor[tile][:, None] == of_row[None, :]] = none
                for p in range(positive.shape[1]):
                    most = np.where(there[tile, p], high * positive[tile, p] // 100, none)
                    s[s > most[:, None]] = none  # the next positives' ranges end no higher
                    i, j, v = _best(s, k, none)
                    s[i, j] = v  # rows may serve the next positive too
                    ok = 100 * v >= low * positive[a + i, p]
                    i, j, v = i[ok], j[ok], v[ok]
                    out.append((mine[a + i], np.full(len(i), p), ids[j], v))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return meet


def mine(df: DataFrame, is_anchor: Column, *, id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5,
         negatives: int = 3, low: int = 50, high: int = 95, scale: float = SCALE, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per anchor (rows where ``is_anchor``, an expression over ``id``), positive and negative: ``anchor_id``, ``positive_id``, ``rank`` (int, from
    1), ``negative_id``, ``positive_score``, ``negative_score`` (long).  Positives are the anchor's ``positives``
    highest rows of its label; of the rows of other labels whose score is ``low`` to ``high`` percent of a positive's,
    the ``negatives`` highest are its negatives."""
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"),
                     F.coalesce(is_anchor, F.lit(False)).alias("anchor"), scaled(F.col(f"`{vector}`"), scale).alias("v")).dropna()
    stat = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("anchors"), F.max(F.size("v")).alias("dims"),
                    F.max(F.array_max("v")).alias("hi"), F.min(F.array_min("v")).alias("lo")).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not stat["anchors"]:
        return spark.createDataFrame([], result)
    dims = 8 * max(1, math.ceil(stat["dims"] / 8))
    planes = max(int(stat["hi"] or 0), -1 - int(stat["lo"] or 0)).bit_length() + 1

    def index(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                lists = part.column("v")
                counts = lists.value_lengths().to_numpy()
                values = np.zeros((len(lists), dims), np.int64)
                values[np.arange(dims)[None, :] < counts[:, None]] = lists.flatten().to_numpy()
                packed = planes_of(values, planes)
                raw = pa.array([x.tobytes() for x in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), part.column("anchor"), raw], ["id", "label", "anchor", "packed"])

    packed = rows.mapInArrow(index, "id long, label string, anchor boolean, packed binary").dropDuplicates()
    packed = materialise(packed.withColumn("no", F.monotonically_increasing_id()), "op12-index")
    blocks = max(1, math.ceil(stat["anchors"] / block_rows))
    chunks = max(math.ceil(stat["n"] / chunk_rows), spark.sparkContext.defaultParallelism)
    deal = lambda n: F.pmod(F.xxhash64("no"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = packed.filter("anchor").select("no", "id", "label", "packed")
    dealt_rows = packed.select(deal(chunks).alias("c"), every(blocks).alias("b"), "no", "id", "label", "packed")

    def grid(block_side: DataFrame, meet, schema: T.StructType) -> DataFrame:
        dealt = block_side.select(deal(blocks).alias("b"), every(chunks).alias("c"), "*")
        return dealt.groupBy("b", "c").cogroup(dealt_rows.groupBy("b", "c")).applyInArrow(meet, schema)

    longs = lambda *names: (", ".join(f"{n} long" for n in names), pa.schema([(n, pa.int64()) for n in names]))
    ddl, schema = longs("no", "other", "score")
    best = Window.partitionBy("no").orderBy(F.col("score").desc(), "other")
    top = (grid(anchors, _positives(planes, positives, schema), ddl).withColumn("k", F.row_number().over(best)).filter(F.col("k") <= positives)
           .groupBy("no").agg(F.sort_array(F.collect_list(F.struct("k", "other", "score"))).alias("positives")))
    armed = materialise(anchors.join(top, "no"), "op12-anchors")
    ddl, schema = longs("no", "p", "negative_id", "negative_score")
    ranked = Window.partitionBy("no", "p").orderBy(F.col("negative_score").desc(), "negative_id")
    found = (grid(armed, _negatives(planes, negatives, low, high, schema), ddl).withColumn("rank", F.row_number().over(ranked))
             .filter(F.col("rank") <= negatives))
    of = armed.select("no", F.col("id").alias("anchor_id"), "positives")
    pos = F.col("positives")[F.col("p").cast("int")]
    return found.join(of, "no").select("anchor_id", pos["other"].alias("positive_id"), "rank", "negative_id", pos["score"].alias("positive_score"), "negative_score")
