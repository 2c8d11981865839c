"""Ranked lexical search by bag deduplication.

A document counts only by the items' terms in it, so texts are reduced to bags: the sorted
hashes of the terms that pass a fixed-size filter of the item vocabulary, their counts, and
the length class m.  Documents of one bag have one score for every item; they are one class (grouped by
hash, told apart by the whole bag) and scored once.  Items are dealt into blocks and classes into chunks
of fixed size; each (block, chunk) meets in one task, which adds term by term the classes' shares into a
(items x classes) table of whole numbers and hands on each item's best classes.  The ``k`` best documents
of an item lie in its ``k`` best classes, ordered by score and smallest id; only those classes
are expanded again, each to its ``k`` smallest ids.

Words are held by 64-bit hashes.  What the filter lets through by chance only makes classes finer.

Results for odd input: null and empty texts, and texts without a term, are no documents and no items.  Rows are
documents of their own, repeated or not; null document ids come last among equal scores.  Rows of one item id, null
included, are one item with all their terms.  Equal scores go by ascending id.  Empty tables, and items none of whose
terms occurs, give no rows.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.words import alnum_table, bitmap, i64, in_bitmap, lists, materialise, text_slices
from tablelens.session import ship_package

#: Bits of the vocabulary filter (2 MB whatever the items).
FILTER_BITS = 24
#: Items of a block and classes of a chunk: what one task scores at once.
BLOCK_ITEMS, CHUNK_CLASSES = 256, 4096


def _terms(items: DataFrame) -> DataFrame:
    """(item_id, h) once for each term of an item."""
    def run(batches):
        for rows, w in text_slices(batches, "text", alnum_table()):
            h, doc = w.hashes(0), w.doc_of()
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
            yield pa.RecordBatch.from_arrays([rows.column("item_id").take(pa.array(doc[new])), i64(h[new])], ["item_id", "h"])

    return items.mapInArrow(run, T.StructType([items.schema["item_id"], T.StructField("h", T.LongType())])).distinct()


def bags(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Of every document with a term: its id, ``n`` (terms with repeats), and ``terms`` and ``tfs`` of those in the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for rows, w in text_slices(batches, "text", alnum_table()):
            h = w.hashes(0)
            at = np.flatnonzero(in_bitmap(sent.value, h))
            doc, h = w.doc_of()[at], h[at]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)])
            tf = np.diff(np.append(first, len(h))).astype(np.int32)
            sizes = np.bincount(doc[first], minlength=len(w.counts))
            out = pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(w.counts.astype(np.int64)), lists(i64(h[first]), sizes), lists(pa.array(tf), sizes)],
                                             ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(w.counts > 0))

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.LongType())),
                           T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema)


def best_of(row: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest positive values, highest first, the first of ties first."""
    at = np.flatnonzero(row > 0)
    if len(at) > k:
        v = row[at]
        at = at[v >= np.partition(v, len(v) - k)[len(v) - k]]
    return at[np.argsort(-row[at], kind="stable")[:k]]


def class_scores(item_of: np.ndarray, h: np.ndarray, w: np.ndarray, n_items: int, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray,
                 m: np.ndarray) -> np.ndarray:
    """(items, classes) scores: the items' terms by (item_of, h, w), the classes' bags one after another."""
    out = np.zeros((n_items, len(sizes)), np.int64)
    order = np.argsort(h, kind="stable")
    item_of, h, w = item_of[order], h[order], w[order]
    words, first = np.unique(h, return_index=True)
    if len(words) == 0 or len(terms) == 0:
        return out
    at = np.minimum(np.searchsorted(words, terms), len(words) - 1)
    hit = np.flatnonzero(words[at] == terms)
    hit = hit[np.argsort(at[hit], kind="stable")]
    at, of, tf = at[hit], np.repeat(np.arange(len(sizes)), sizes)[hit], tfs[hit].astype(np.int64)
    share = w[first][at] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[of]))
    begin = np.searchsorted(at, np.arange(len(words) + 1))
    ends = np.append(first[1:], len(h))
    for t in np.unique(at).tolist():
        classes, add = of[begin[t] : begin[t + 1]], share[begin[t] : begin[t + 1]]
        for i in item_of[first[t] : ends[t]].tolist():
            out[i, classes] += add  # a class holds a term once
    return out


def _meet(k: int, schema: pa.Schema):
    def meet(block: pa.Table, chunk: pa.Table) -> pa.Table:
        out = []
        if block.num_rows and chunk.num_rows:
            chunk = chunk.sort_by([("first", "ascending"), ("class_no", "ascending")])  # nulls last
            items, item_of = np.unique(block["item_no"].to_numpy(), return_inverse=True)
            terms, tfs = chunk["terms"].combine_chunks(), chunk["tfs"].combine_chunks()
            s = class_scores(item_of, block["h"].to_numpy(), block["w"].to_numpy(), len(items), terms.flatten().to_numpy(), tfs.flatten().to_numpy(),
                             terms.value_lengths().to_numpy(), chunk["m"].to_numpy())
            for i, item in enumerate(items.tolist()):
                at = best_of(s[i], k)
                out.append((np.full(len(at), item), at, s[i][at]))
        if not out:
            return schema.empty_table()
        item, at, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(item), chunk["class_no"].take(pa.array(at)).combine_chunks(), chunk["first"].take(pa.array(at)).combine_chunks(),
                                     pa.array(score)], schema=schema)

    return meet


def search(docs: DataFrame, items: DataFrame, *, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
           block_items: int = BLOCK_ITEMS, chunk_classes: int = CHUNK_CLASSES) -> DataFrame:
    """``item_id``, ``rank`` (int, from 1), ``doc_id`` (long) and ``score`` (long): the ``k`` highest-scoring documents of each item.

    A term's weight w is floor(1000 ln((2N+2)/(2df+1))), a document's m is 50 + 50 n N div L, and its score sums
    w * (10**9 tf div (1000 tf + 20 m)) over the item's terms, for N documents with L terms."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    items = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    wanted = materialise(_terms(items), "op13-terms")
    bag = materialise(bags(docs, bitmap(wanted.select("h").distinct(), "h", FILTER_BITS)), "op13-bags")
    stat = bag.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n, total = stat["n"], stat["l"] or 1
    keys = ["bag", "m", "terms", "tfs"]
    members = (bag.filter(F.size("terms") > 0).withColumn("m", F.expr(f"50 + (50 * n * {n}L) div {total}L"))
               .select("doc_id", F.xxhash64("m", "terms", "tfs").alias("bag"), *keys[1:]))
    classes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
    classes = materialise(classes.withColumn("class_no", F.monotonically_increasing_id()), "op13-classes")
    df = classes.select(F.explode("terms").alias("h"), "copies").groupBy("h").agg(F.sum("copies").alias("df"))
    numbered = wanted.select(F.col("item_id").alias("_id")).distinct().withColumn("item_no", F.monotonically_increasing_id())
    numbered = materialise(numbered, "op13-items")
    weight = F.floor(F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1)) * 1000).cast("long")
    weighted = (wanted.join(numbered, F.col("item_id").eqNullSafe(F.col("_id"))).join(df, "h")
                .select("item_no", "h", weight.alias("w")))
    sizes = numbered.agg(F.count(F.lit(1)).alias("n")).first()["n"], classes.count()
    blocks = max(1, math.ceil(sizes[0] / block_items))
    chunks = max(math.ceil(sizes[1] / chunk_classes), spark.sparkContext.defaultParallelism)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = weighted.select(F.pmod(F.xxhash64("item_no"), F.lit(blocks)).cast("int").alias("b"), every(chunks).alias("c"), "*")
    right = classes.select(F.pmod(F.xxhash64("class_no"), F.lit(chunks)).cast("int").alias("c"), every(blocks).alias("b"), "class_no", "first", "m", "terms", "tfs")
    names = ("item_no", "class_no", "first", "score")
    found = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(_meet(k, pa.schema([(c, pa.int64()) for c in names])),
                                                                                ", ".join(f"{c} long" for c in names))
    best = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.asc_nulls_last("first"), "class_no")
    top = materialise(found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("item_no", "class_no", "score"), "op13-top")
    chosen = classes.join(top.select("class_no").distinct(), "class_no")
    of_class = Window.partitionBy("class_no").orderBy(F.asc_nulls_last("doc_id"))
    several = members.join(chosen.filter(F.col("copies") > 1).select("class_no", *keys), keys).select("class_no", "doc_id")
    expanded = (several.withColumn("r", F.row_number().over(of_class)).filter(F.col("r") <= k).drop("r")
                .unionByName(chosen.filter(F.col("copies") == 1).select("class_no", F.col("first").alias("doc_id"))))
    of_item = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.asc_nulls_last("doc_id"))
    ranked = top.join(expanded, "class_no").withColumn("rank", F.row_number().over(of_item)).filter(F.col("rank") <= k)
    return ranked.join(numbered, "item_no").select(F.col("_id").alias("item_id"), "rank", "doc_id", "score")
