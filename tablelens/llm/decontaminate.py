"""Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows (``window`` words; a shorter item is one
window).  A window is the set of its word shingles with their places in it,
and a document holds it only if it holds all of them, so the necessary prefix
(|S| - |S| + 1 = 1 token) is the rarest shingle, by counts over all documents.
The rarest shingle is joined on, the place it has in the window bounds where
the window would start and end in the document, and the window found there is
verified as a whole (two 64-bit hashes of its words).

Only two filters of fixed size are broadcast; benchmark and documents may both
be of any size.

Null or wordless texts have no words and no windows.  Each input row gives one
result row; repeated rows are judged each for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.words import (U64, alnum_table, bitmap, i64, in_bitmap, lists, materialise, mix, text_slices,
                                 tidy, window_hashes)
from tablelens.session import ship_package

#: Bits of each broadcast filter (4 MB).
FILTER_BITS = 25


def _shingle_len(m: int, k: int) -> int:
    return min(k, m)


def _placed(s: np.ndarray, off, m: int) -> np.ndarray:
    """Key of a shingle at a place of a window of m words."""
    return mix(s ^ (np.asarray(off, U64) * U64(0x9E3779B97F4A7C15)) ^ U64(m * 0x85EBCA6B))


def item_windows(items: DataFrame, item_id: str, text: str, window: int, k: int) -> DataFrame:
    """(item_id, w1, w2, m, shingles, placed): one row per window of each item."""
    table = alnum_table()

    @tidy
    def run(batches):
        for rows, w in text_slices(batches, "_text", table):
            n = w.counts
            room, doc = w.room(), w.doc_of()
            h1, h2 = w.hashes(0), w.hashes(1)
            for m in np.unique(np.minimum(n[n > 0], window)).tolist():
                mine = (np.minimum(n, window) == m)[doc]
                at = np.flatnonzero(mine & (room >= m))
                s = window_hashes(h1, _shingle_len(m, k))
                per = m - _shingle_len(m, k) + 1
                idx = at[:, None] + np.arange(per)
                yield pa.RecordBatch.from_arrays([
                    rows.column("_id").take(pa.array(doc[at])), i64(window_hashes(h1, m)[at]), i64(window_hashes(h2, m, 1)[at]),
                    pa.array(np.full(len(at), m, np.int32)), lists(i64(s[idx].ravel()), np.full(len(at), per)),
                    lists(i64(_placed(s[idx], np.arange(per), m).ravel()), np.full(len(at), per))],
                    ["item_id", "w1", "w2", "m", "shingles", "placed"])

    src = items.select(F.col(item_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"item_id {kind}, w1 long, w2 long, m int, shingles array<long>, placed array<long>")


def _shingle_counts(docs: DataFrame, filter_words, lens: list[int]) -> DataFrame:
    """How often each shingle that passes the filter occurs in all documents."""
    table = alnum_table()

    @tidy
    def run(batches):
        for _, w in text_slices(batches, "_text", table):
            room, h = w.room(), w.hashes(0)
            for q in lens:
                s = window_hashes(h, q)[room >= q]
                u, c = np.unique(s[in_bitmap(filter_words.value, s)], return_counts=True)
                yield pa.RecordBatch.from_arrays([i64(u), pa.array(c.astype(np.int64))], ["s", "n"])

    return docs.select("_text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, prefix_words, place_words, shapes: list[int], k: int, doc_type: str) -> DataFrame:
    table = alnum_table()

    @tidy
    def run(batches):
        cols = ["doc_id", "text_hash", "n_words", "found"]
        for rows, w in text_slices(batches, "_text", table):
            room, doc, n = w.room(), w.doc_of(), w.counts
            behind = np.arange(len(doc)) - np.repeat(w.first[:-1], n)  # words of the text before each
            h1, h2 = w.hashes(0), w.hashes(1)
            out = []
            for m in shapes:
                q = _shingle_len(m, k)
                s = window_hashes(h1, q)
                at = np.flatnonzero((room >= q) & in_bitmap(prefix_words.value, s))
                for off in range(m - q + 1):
                    p = at[in_bitmap(place_words.value, _placed(s[at], off, m))]
                    p = p[(behind[p] >= off) & (room[p] >= m - off)] - off
                    out.append((p, np.full(len(p), m, np.int32)))
            p = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
            m = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int32)
            order = np.lexsort((m, p))
            p, m = p[order], m[order]
            w1, w2 = np.zeros(len(p), U64), np.zeros(len(p), U64)
            for x in np.unique(m).tolist():
                sel = m == x
                w1[sel], w2[sel] = window_hashes(h1, x)[p[sel]], window_hashes(h2, x, 1)[p[sel]]
            found = pa.StructArray.from_arrays([pa.array(behind[p].astype(np.int32)), pa.array(m), i64(w1), i64(w2)], ["start", "m", "w1", "w2"])
            per = np.bincount(doc[p], minlength=len(n)) if len(p) else np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("_id"), rows.column("_th"), pa.array(n.astype(np.int64)), lists(found, per)], cols)

    return docs.mapInArrow(run, f"doc_id {doc_type}, text_hash long, n_words long, found array<struct<start:int,m:int,w1:long,w2:long>>")


def _covered(spans: str) -> F.Column:
    """Words under the union of sorted (start, m) spans."""
    return F.expr(f"""aggregate({spans}, named_struct('n', 0L, 'till', 0),
        (a, x) -> named_struct('n', a.n + greatest(0, x.start + x.m - greatest(x.start, a.till)),
                               'till', greatest(a.till, x.start + x.m)), a -> a.n)""")


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 13, shingle: int = 3,
                  min_share: tuple[int, int] = (1, 20)) -> DataFrame:
    """One row per document: doc_id, text_hash (Spark's xxhash64, to find the row by), n_words, n_hit, spans (start, m of each window found), items
    (distinct ids whose windows occur), contaminated (n_hit > 0 and n_hit at least the
    fraction min_share of n_words)."""
    spark = docs.sparkSession
    ship_package(spark)
    sc = spark.sparkContext
    wins = materialise(item_windows(items, item_id, item_text, window, shingle), "decon-windows")
    unique = wins.groupBy("w1", "w2", "m").agg(F.first("shingles").alias("shingles"), F.first("placed").alias("placed"))
    shapes = sorted(r.m for r in wins.select("m").distinct().collect())  # at most `window` values
    src = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    lens = sorted({_shingle_len(m, shingle) for m in shapes})
    every = sc.broadcast(bitmap(wins.select(F.explode("shingles").alias("s")), "s", FILTER_BITS))
    counts = _shingle_counts(src, every, lens)
    placed = unique.select("w1", "w2", "m", F.explode(F.arrays_zip("shingles", "placed")).alias("x")).select("w1", "w2", "m", F.col("x.shingles").alias("s"), F.col("x.placed").alias("p"))
    # a window with a shingle that no document has occurs nowhere; else its rarest shingle stands for it
    rare = (placed.join(counts, "s", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            .groupBy("w1", "w2", "m").agg(F.min(F.struct("n", "s", "p")).alias("r")).filter("r.n > 0")
            .select("w1", "w2", "m", "r.s", "r.p"))
    rare = materialise(rare, "decon-prefix")
    prefix = sc.broadcast(bitmap(rare, "s", FILTER_BITS))
    places = sc.broadcast(bitmap(rare, "p", FILTER_BITS))
    found = _candidates(src.withColumn("_th", F.xxhash64("_text")), prefix, places, shapes, shingle, src.schema["_id"].dataType.simpleString())
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "decon-found")

    hits = found.select("row", F.explode("found").alias("x")).select("row", "x.*").join(rare.select("w1", "w2", "m"), ["w1", "w2", "m"])
    spans = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "m"))).alias("spans"))
    held = (hits.select("row", "w1", "w2").distinct().join(wins.select("w1", "w2", "item_id").distinct(), ["w1", "w2"])
            .groupBy("row").agg(F.collect_set("item_id").alias("items")))
    none = "array<struct<start:int,m:int>>"
    out = (found.select("row", "doc_id", "text_hash", "n_words").join(spans, "row", "left").join(held, "row", "left")
           .withColumn("spans", F.coalesce("spans", F.array().cast(none)))
           .withColumn("items", F.coalesce("items", F.array().cast(held.schema["items"].dataType)))
           .withColumn("n_hit", _covered("spans")))
    return out.select("doc_id", "text_hash", "n_words", "n_hit", "spans", "items",
                      ((F.col("n_hit") > 0) & (F.col("n_hit") * min_share[1] >= F.col("n_words") * min_share[0])).alias("contaminated"))
