"""MinHash near-dedup by a multi-index Hamming join.

A document's set of word shingles gives a signature of ``CHUNKS * CHUNK`` symbols of
16 bits (low bits of one minimum each).  Two signatures with at most
``2 * CHUNKS - 1`` unequal symbols have, by pigeonhole, a chunk with at most one
unequal symbol.  So each chunk is enumerated with every one of its symbols left
out, and signatures meet in the bucket of each such key: all pairs under that
distance meet, and most pairs somewhat beyond it.

Links are confirmed on the full shingle sets.  Pairs within a bucket are not
listed.  Documents of equal sets are one class.  Then

1. every class is compared with the centre it shares most buckets with: a bucket's
   centre is its class whose buckets are largest (the one that others are copies of);
2. confirmed links give components, and only buckets that still hold classes of
   different components give pairs, across components. How two classes differ from a
   common centre bounds how much they have in common, so most pairs of edited copies
   are refuted there; the others that meet are compared in full, each in its first
   common bucket. So every pair within the distance is confirmed, refuted or inside a
   component.

Buckets are ordinary joins and pre-aggregated groups, so a bucket of any size is
spread over tasks.

Null and wordless texts have an empty set and are linked with nothing.  Texts of
fewer words than a shingle are one shingle.  Rows with the same id and text are one
document with one result row each; a null id never is a component's id unless all are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.words import U64, Words, blank_table, buffers, folded, i64, materialise, mix, text_slices, tidy, window_hashes
from tablelens.session import ship_package

CHUNKS, CHUNK = 12, 6
#: Pairs across components are compared up to so many unequal symbols: four deviations beyond
#: what pairs at similarity 0.8 have on average, more than the 2 * CHUNKS - 1 that are sure to meet.
FAR = 28
#: Classes of one bucket that are compared in one group.
TILE = 2048
#: Cells in which differences from a centre are counted.
DIFF_CELLS = 128
#: Rows of an Arrow batch that holds texts: it lies in the JVM and in the worker.
BATCH_ROWS = 1000
#: Text of the pairs that one step compares.
PAIR_BYTES = 1 << 20


def _sets(w: Words, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it; where each text's begin, and the end."""
    n, room = w.counts, w.room()
    h = window_hashes(w.hashes(seed), k, seed)
    short = (n > 0) & (n < k)
    at = np.flatnonzero(room >= k)
    first = w.first[:-1][short]
    whole = np.zeros(len(first), U64)
    for m in np.unique(n[short]).tolist():
        whole[n[short] == m] = window_hashes(w.hashes(seed), m, seed)[first[n[short] == m]]
    doc = np.concatenate([w.doc_of()[at], np.flatnonzero(short)])
    h = np.concatenate([h[at], whole])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def _signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """text x symbol; zeros for empty sets."""
    size = CHUNKS * CHUNK
    odd = np.random.default_rng(3).integers(0, 2**63, (size, 2), dtype=np.int64).astype(U64) | U64(1)
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, size), np.uint16)
    if len(full):
        for i in range(size):
            out[full, i] = mix(np.minimum.reduceat((h ^ odd[i, 0]) * odd[i, 1], first[full])) >> U64(40)
    return out


def _scan(docs: DataFrame, k: int) -> DataFrame:
    table = folded(blank_table())

    @tidy
    def run(batches):
        for rows, w in text_slices(batches, "_text", table):
            h, first = _sets(w, k)
            other, _ = _sets(w, k, 1)
            n = np.diff(first)
            # digest of a set: two sums of its mixed hashes, over two independent hashes
            d = [np.add.reduceat(np.append(mix(x ^ U64(77 + j)), U64(0)), np.minimum(f[:-1], len(x))) * (np.diff(f) > 0).astype(U64)
                 for j, (x, f) in enumerate(((h, first), (other, _)))]
            sig = _signatures(h, first)
            yield pa.RecordBatch.from_arrays([
                rows.column("_id"), rows.column("_th"), pa.array(n.astype(np.int64)), i64(d[0]), i64(d[1]),
                pa.FixedSizeBinaryArray.from_buffers(pa.binary(sig.shape[1] * 2), len(n), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())],
                ["doc_id", "th", "n", "d1", "d2", "sig"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['_id'].dataType.simpleString()}, th long, n long, d1 long, d2 long, sig binary")


def _keys(classes: DataFrame) -> DataFrame:
    """(key, slot, c): every chunk with one symbol left out; slot says which."""
    @tidy
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            data, _ = buffers(batch.column("sig"))
            sig = data.view(np.uint16).reshape(batch.num_rows, CHUNKS, CHUNK).astype(U64)
            c = batch.column("c").to_numpy()
            for i in range(CHUNKS):
                for j in range(CHUNK):
                    key = np.full(len(c), i * CHUNK + j + 1, U64)
                    for s in range(CHUNK):
                        if s != j:
                            key = mix(key * U64(0x9E3779B97F4A7C15) + sig[:, i, s])
                    yield pa.RecordBatch.from_arrays([i64(key), pa.array(np.full(len(c), i * CHUNK + j, np.int32)), pa.array(c)], ["key", "slot", "c"])

    return classes.select("c", "sig").mapInArrow(run, "key long, slot int, c long")


def _compared(pairs: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes on full sets: ok (den * |intersection| >= num * |union|), and how they differ:
    apart (size of the symmetric difference) and diff (its elements counted by hash into DIFF_CELLS cells)."""
    table = folded(blank_table())

    @tidy
    def run(batches):
        for batch in batches:
            size = np.diff(buffers(batch.column("ta"))[1]) + np.diff(buffers(batch.column("tb"))[1])
            step = np.cumsum(size) // PAIR_BYTES
            cuts = [*np.flatnonzero(np.diff(step, prepend=-1)).tolist(), len(size)]
            for begin, stop in zip(cuts, cuts[1:]):
                rows = batch.slice(begin, stop - begin)
                (x, fx), (y, fy) = (_sets(Words(*buffers(rows.column(c)), table), k) for c in ("ta", "tb"))
                ok, apart, diff = [], [], []
                for i in range(rows.num_rows):
                    p, q = x[fx[i]:fx[i + 1]], y[fy[i]:fy[i + 1]]
                    other = np.setxor1d(p, q, assume_unique=True)
                    both = (len(p) + len(q) - len(other)) // 2
                    ok.append(den * both >= num * (both + len(other)))
                    apart.append(len(other))
                    diff.append(np.bincount(other & U64(DIFF_CELLS - 1), minlength=DIFF_CELLS).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(ok, pa.bool_()), pa.array(apart, pa.int64()), pa.array(diff, pa.binary())],
                                                 ["a", "b", "ok", "apart", "diff"])

    one = sets.select(F.col("c").alias("a"), F.col("text").alias("ta"))
    two = sets.select(F.col("c").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(
        run, "a long, b long, ok boolean, apart long, diff binary")


def _met(group: pa.Table, num: int, den: int) -> pa.Table:
    """Pairs (a, b) of a bucket's classes of two tiles and of different components whose signatures differ in at
    most FAR symbols, that their sizes and differences from a common centre let be similar enough, and
    whose first common key this is.  Sets x, y differ in |x ^ y| = |x ^ m| + |y ^ m| - 2 |(x ^ m) & (y ^ m)| elements."""
    group = group.combine_chunks()
    slot = group["slot"][0].as_py()
    chunk, left_out = divmod(slot, CHUNK)
    c, comp, n, centre, apart, tile = (group[x].to_numpy() for x in ("c", "comp", "n", "centre", "apart", "tile"))
    diff = np.frombuffer(b"".join(x or bytes(4 * DIFF_CELLS) for x in group["diff"].to_pylist()), "<u4").reshape(len(c), -1)
    sig = buffers(group["sig"])[0].view(np.uint16).reshape(len(c), -1)
    p, q = group["p"][0].as_py(), group["q"][0].as_py()
    rows, cols = np.flatnonzero(tile == p), np.flatnonzero(tile == q)
    out = []
    for x in range(0, len(rows), 64):
        i = rows[x:x + 64]
        less, more = np.minimum(n[i][:, None], n[cols]), np.maximum(n[i][:, None], n[cols])
        may = (comp[i][:, None] != comp[cols]) & (den * less >= num * more)
        if p == q:
            may &= c[i][:, None] < c[cols]
        u, v = np.nonzero(may)
        u, v = i[u], cols[v]
        for y in range(0, len(u), 1 << 16):
            a, b = u[y:y + (1 << 16)], v[y:y + (1 << 16)]
            unequal = (sig[a] != sig[b]).reshape(len(a), CHUNKS, CHUNK)
            wrong = unequal.sum(2)
            near = wrong <= 1
            first = near.argmax(1) == chunk
            mine = np.where(wrong[:, chunk] == 1, unequal[:, chunk, left_out], left_out == 0)
            ok = (wrong.sum(1) <= FAR) & near[:, chunk] & first & mine
            a, b = a[ok], b[ok]
            # of one centre: elements in which both differ from it are counted from above, cell by cell
            shared = np.minimum(diff[a], diff[b]).sum(1, dtype=np.int64)
            differ = np.where(centre[a] == centre[b], apart[a] + apart[b] - 2 * shared, 0)
            ok = (den + num) * differ <= (den - num) * (n[a] + n[b])
            out.append(np.sort(np.stack([c[a[ok]], c[b[ok]]]), axis=0))
    both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return pa.table({"a": pa.array(both[0].astype(np.int64)), "b": pa.array(both[1].astype(np.int64))})


def components(edges: DataFrame) -> DataFrame:
    """(c, comp) for every node of the links (a, b): the smallest node reachable.

    Alternates large-star and small-star steps, each two shuffles over the links; every
    round is written to the shared folder.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = materialise(large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
                        .select("x.u", "x.v").filter("u <> v").distinct(), "links")
        now = e.agg(F.count("u"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("c"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("c"), F.col("v").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
                    similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable), kept
    (is it that one), text_hash (Spark's xxhash64 of the text, to find the row by)."""
    ship_package(docs.sparkSession)
    num, den = similarity
    src = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).withColumn("_th", F.xxhash64("_text"))
    scan = materialise(_scan(src, shingle), "minhash", BATCH_ROWS)
    classes = materialise(scan.filter("n > 0").groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("rep"), F.first("sig").alias("sig"), F.first("n").alias("n"))
                          .withColumn("c", F.monotonically_increasing_id()), "minhash-classes")

    # buckets of two classes or more
    keys = _keys(classes)
    buckets = materialise(keys.join(keys.groupBy("key").agg(F.count("c").alias("n")).filter("n > 1"), "key"), "minhash-buckets")
    rank = buckets.groupBy("c").agg(F.sum("n").alias("size"))
    ranked = buckets.select("key", "c").join(rank, "c")
    centres = ranked.groupBy("key").agg(F.max(F.struct("size", (-F.col("c")).alias("c"))).alias("m")).select("key", (-F.col("m.c")).alias("b"))
    tried = (buckets.select("key", F.col("c").alias("a")).join(centres, "key").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b")))
    tried = materialise(tried, "minhash-tried")

    # texts of the classes that meet another one
    want = rank.select("c").join(classes.select("c", F.col("rep.doc_id").alias("_id"), F.col("rep.th").alias("_th")), "c")
    texts = (
        src.alias("s").join(want.alias("w"), (F.col("s._th") == F.col("w._th")) & F.col("s._id").eqNullSafe(F.col("w._id")))
        .select(F.col("w.c").alias("c"), F.col("s._text").alias("text")).dropDuplicates(["c"]))
    texts = materialise(texts, "minhash-texts")
    compared = materialise(_compared(tried, texts, shingle, num, den), "minhash-links", BATCH_ROWS)
    links = compared.filter("ok").select("a", "b")

    # what still lies across components
    comp = components(links)
    label = buckets.select("key", "slot", "c").join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    label = materialise(label, "minhash-labels")
    mixed = label.join(label.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key"), "key")
    # buckets in tiles of bounded size, every two of which meet in a group
    tiles = mixed.groupBy("key").agg(F.ceil(F.count("c") / TILE).cast("int").alias("tiles"))
    known = classes.select("c", "sig", "n").join(compared.select(F.col("a").alias("c"), F.col("b").alias("centre"), "apart", "diff"), "c", "left")
    rows = (mixed.join(tiles, "key").join(known, "c").withColumns({"centre": F.coalesce("centre", "c"), "apart": F.coalesce("apart", F.lit(0).cast("long"))})
            .withColumn("tile", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))
            .withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
            .select("key", "slot", "c", "comp", "n", "centre", "apart", "diff", "sig", "tile", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q")))
    cross = rows.groupBy("key", "p", "q").applyInArrow(lambda group: _met(group, num, den), "a long, b long")
    cross = materialise(cross.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "minhash-cross")
    more = _compared(cross, texts, shingle, num, den).filter("ok").select("a", "b")
    comp = components(links.union(more))

    by_class = classes.select("c", "d1", "d2", F.col("rep.doc_id").alias("id")).join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    heads = by_class.groupBy("comp").agg(F.min("id").alias("component_id"))
    found = by_class.join(heads, "comp").select("d1", "d2", "component_id")
    out = (scan.filter("n > 0").select("doc_id", "th", "n", "d1", "d2").join(found, ["d1", "d2"], "left").select("doc_id", "th", "n", "component_id")
           .union(scan.filter("n = 0").select("doc_id", "th", "n", F.col("doc_id").alias("component_id"))))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
                      F.col("th").alias("text_hash"))
