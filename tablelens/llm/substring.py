"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words of a document.  Its minimiser is the
smallest hash of the grams of so many words in it.  Equal windows have equal
minimisers:

1. places of minimisers of long grams (``probe`` words) are counted over all
   documents; a window can repeat only under one with two places or more (a filter
   of fixed size holds those);
2. consecutive windows that may repeat and share a minimiser of short grams (``m``
   words) form a super-k-mer, one span of words, which travels as a packed string
   to the minimiser's bucket, once for all equal ones of a slice of documents;
3. a bucket cuts its strings into windows again, sorts them, and finds the
   first place (smallest id, then smallest start) of every window; a minimiser whose
   strings are too many for that (no number of buckets splits it) gets no bucket: its
   distinct strings are cut into windows, rows that are grouped by their own hashes;
4. super-k-mers with repeats are joined back to their places, and the words
   under windows that start elsewhere first are removed.

A passage in any share of all documents is one string per slice in step 2 and one
row on the smaller side of the join in step 4.  Windows are compared by two
64-bit hashes of their words, the packed words themselves decide nothing more.

Null texts have no words; documents of fewer than ``k`` words have no window.
Rows with the same id are one document as far as order goes: a window is
removed only if its words also start at a smaller (id, start).  Null ids come last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.words import (U64, Words, bitmap, blank_table, buffers, i64, in_bitmap, joined, lists, materialise, ranges, sliding,
                                 span_hashes, take_bytes, text_slices, tidy, window_hashes)
from tablelens.session import ship_package

FILTER_BITS = 27
#: Packed bytes that one bucket should hold, and those of one minimiser from which its windows are dealt one by one.
BUCKET_BYTES = 1 << 20
HOT_BYTES = 1 << 20


def _minimisers(w: Words, k: int, m: int):
    """Per word: is it the start of a window, and the window's minimiser; and the hashes of m-grams."""
    room = w.room()
    grams = w.windows(m)
    grams[room < m] = U64(2**64 - 1)
    return room >= k, sliding(np.minimum, grams, k - m + 1), grams


def _minimiser_counts(docs: DataFrame, k: int, m: int) -> DataFrame:
    table = blank_table()

    @tidy
    def run(batches):
        for _, w in text_slices(batches, "_text", table):
            ok, low, grams = _minimisers(w, k, m)
            reach = np.where(ok, low, U64(0))[::-1]
            used = sliding(np.maximum, reach, k - m + 1)[::-1]  # the largest minimiser of the windows over each gram
            at = ok | (w.room() >= m)
            places = grams[at & (used == grams) & (used > 0)]
            u, n = np.unique(places, return_counts=True)
            yield pa.RecordBatch.from_arrays([i64(u), pa.array(n.astype(np.int64))], ["g", "n"])

    return (docs.select("_text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
            .filter("n > 1").select("g"))


_SPAN = "array<struct<s1:long,s2:long,start:int,n:int>>"


def _pack(docs: DataFrame, repeated, k: int, probe: int, m: int, id_type: str) -> DataFrame:
    """Two kinds of rows: documents (doc_id, n_words, digest of all words, text and spans if any super-k-mer
    may repeat) and packed strings (bucket gram, hashes, string, first place in the slice)."""
    table = blank_table()
    names = ["is_doc", "doc_id", "n_words", "sha", "text", "spans", "g", "s1", "s2", "packed", "first_start", "many"]

    @tidy
    def run(batches):
        for rows, w in text_slices(batches, "_text", table):
            ok, long_low, _ = _minimisers(w, k, probe)
            n, doc = w.counts, w.doc_of()
            ids = rows.column("_id")
            behind = np.arange(len(doc)) - np.repeat(w.first[:-1], n)
            if len(ok):  # the filter is asked once per run of one minimiser
                new = np.append(True, long_low[1:] != long_low[:-1])
                ok &= in_bitmap(repeated.value, long_low[new])[np.cumsum(new) - 1]
            _, low, _ = _minimisers(w, k, m)
            # runs of windows of one document and one minimiser
            new = ok.copy()
            if len(ok):
                new[1:] &= ~(ok[:-1] & (low[1:] == low[:-1]) & (doc[1:] == doc[:-1]))
            a = np.flatnonzero(new)
            stop = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True)) + 1 if len(ok) else a
            end = stop + k - 1
            s1, s2 = span_hashes(w.hashes(0), a, end, 0), span_hashes(w.hashes(1), a, end, 1)
            per = np.bincount(doc[a], minlength=len(n)) if len(a) else np.zeros(len(n), np.int64)
            spans = pa.StructArray.from_arrays([i64(s1), i64(s2), pa.array(behind[a].astype(np.int32)), pa.array((stop - a).astype(np.int32))], ["s1", "s2", "start", "n"])
            whole, o = joined(w)
            sha = [hashlib.sha256(whole[x:y]).digest() for x, y in zip(o, o[1:])]
            d = len(n)
            text = rows.column("_text").take(pa.array(np.arange(d), mask=per == 0))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.ones(d, bool)), ids, pa.array(n.astype(np.int64)), pa.array(sha, pa.binary()), text, lists(spans, per),
                *[pa.nulls(d, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.bool_())]], names)
            if len(a) == 0:
                continue
            # equal super-k-mers of the slice travel once, with their first place
            rank = np.empty(d, np.int64)
            rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(d)
            order = np.lexsort((behind[a], rank[doc[a]], s2, s1))
            p1, p2 = s1[order], s2[order]
            lead = np.append(True, (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1]))
            heads = np.flatnonzero(lead)
            many = np.diff(np.append(heads, len(order))) > 1
            x = order[heads]
            u = len(x)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.zeros(u, bool)), ids.take(pa.array(doc[a[x]])), *[pa.nulls(u, t) for t in (pa.int64(), pa.binary(), pa.string(), spans_type)],
                i64(low[a[x]]), i64(s1[x]), i64(s2[x]), take_bytes(w.data, w.starts[a[x]], w.ends[end[x] - 1]),
                pa.array(behind[a[x]].astype(np.int32)), pa.array(many)], names)

    spans_type = pa.list_(pa.struct([("s1", pa.int64()), ("s2", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))
    return docs.select("_id", "_text").mapInArrow(
        run, f"is_doc boolean, doc_id {id_type}, n_words long, sha binary, text string, spans {_SPAN}, g long, s1 long, s2 long, "
             "packed binary, first_start int, many boolean")


def _bucket_firsts(strings: DataFrame, k: int, id_type: str) -> DataFrame:
    """(s1, s2, runs): super-k-mers with a repeated window; runs of windows (at, n) whose first place begins at (id, start)."""
    table = blank_table()
    run_names = ["at", "n", "id", "start"]

    def firsts(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group["doc_id"].combine_chunks()
        w = Words(*buffers(group["packed"]), table)
        n = w.counts - (k - 1)  # windows of each string
        string = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
        at = w.first[string] + off
        h1, h2 = window_hashes(w.hashes(0), k, 0)[at], window_hashes(w.hashes(1), k, 1)[at]
        pos = group["first_start"].to_numpy()[string] + off
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        # equal ids get equal ranks
        order0 = np.argsort(rank)
        same = pc.equal(ids.take(pa.array(order0[1:])), ids.take(pa.array(order0[:-1]))) if len(ids) > 1 else pa.array([], pa.bool_())
        same = pc.fill_null(same, True) if ids.null_count else same  # only null and null compare as null, at the end
        if ids.null_count and len(ids) > ids.null_count:
            same = pa.array(np.where(np.arange(1, len(ids)) == len(ids) - ids.null_count, False, same.to_numpy(zero_copy_only=False)))
        rank[order0] = np.cumsum(np.append(0, ~same.to_numpy(zero_copy_only=False)))
        order = np.lexsort((pos, rank[string], h2, h1))
        a, b = h1[order], h2[order]
        lead = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        first = np.empty(len(order), np.int64)
        first[order] = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]  # the window that is the first place
        size = np.bincount(np.cumsum(lead) - 1)
        shared = np.empty(len(order), bool)
        shared[order] = (size > 1)[np.cumsum(lead) - 1]
        repeats = np.bincount(string, shared, len(n)) > 0
        repeats |= group["many"].to_numpy(zero_copy_only=False)
        # one row per distinct string
        s1, s2 = group["s1"].to_numpy(), group["s2"].to_numpy()
        o = np.lexsort((s2, s1))
        once = np.zeros(len(n), bool)
        once[o] = np.append(True, (s1[o][1:] != s1[o][:-1]) | (s2[o][1:] != s2[o][:-1]))
        pick = once & repeats
        mine = np.flatnonzero(pick[string])
        f_rank, f_pos = rank[string[first[mine]]], pos[first[mine]]
        begin = np.ones(len(mine), bool)
        begin[1:] = (string[mine][1:] != string[mine][:-1]) | (f_rank[1:] != f_rank[:-1]) | (f_pos[1:] != f_pos[:-1] + 1)
        heads = np.flatnonzero(begin)
        x = mine[heads]
        runs = pa.StructArray.from_arrays([
            pa.array(off[x].astype(np.int32)), pa.array(np.diff(np.append(heads, len(mine))).astype(np.int32)),
            ids.take(pa.array(string[first[x]])), pa.array(f_pos[heads].astype(np.int32))], run_names)
        per = np.bincount(string[x], minlength=len(n))[pick]
        return pa.table({"s1": s1[pick], "s2": s2[pick], "runs": lists(runs, per)})

    few, hot = _by_bytes(strings)
    total = few.agg(F.sum(F.length("packed"))).first()[0] or 0
    buckets = max(int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    keyed = few.select("doc_id", "s1", "s2", "packed", "first_start", "many", F.expr(f"pmod(g, {buckets})").alias("bucket"))
    out = keyed.groupBy("bucket").applyInArrow(
        firsts, f"s1 long, s2 long, runs array<struct<at:int,n:int,id:{id_type},start:int>>")
    return out if hot is None else out.unionByName(_window_firsts(hot, k, id_type))


def _by_bytes(strings: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Strings of minimisers of at most HOT_BYTES packed bytes, and those of the others, if any."""
    # at most one row per HOT_BYTES of all strings
    hot = materialise(strings.groupBy("g").agg(F.sum(F.length("packed")).alias("n")).filter(F.col("n") > HOT_BYTES).select("g"), "substring-hot")
    if hot.isEmpty():
        return strings, None
    return strings.join(hot, "g", "left_anti"), strings.join(hot, "g", "left_semi")


def _window_firsts(strings: DataFrame, k: int, id_type: str) -> DataFrame:
    """The same as _bucket_firsts, without a group that has to fit a task: a row per window of each distinct string."""
    table = blank_table()

    @tidy
    def run(batches):
        for rows, w in text_slices(batches, "packed", table):
            n = w.counts - (k - 1)
            string = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
            at = w.first[string] + off
            which = pa.array(string)
            yield pa.RecordBatch.from_arrays([
                *[rows.column(c).take(which) for c in ("s1", "s2", "doc_id", "many")], pa.array(off.astype(np.int32)),
                pa.array((rows.column("first_start").to_numpy()[string] + off).astype(np.int32)),
                i64(window_hashes(w.hashes(0), k, 0)[at]), i64(window_hashes(w.hashes(1), k, 1)[at])],
                ["s1", "s2", "doc_id", "many", "at", "start", "w1", "w2"])

    once = (strings.groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "first_start")).alias("p"),
                                            (F.max("many") | (F.count(F.lit(1)) > 1)).alias("many"), F.first("packed").alias("packed"))
            .select("s1", "s2", "p.doc_id", "p.first_start", "many", "packed"))
    windows = once.mapInArrow(run, f"s1 long, s2 long, doc_id {id_type}, many boolean, at int, start int, w1 long, w2 long")
    shared = (windows.groupBy("w1", "w2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "start")).alias("first"),
                                              (F.max("many") | (F.count(F.lit(1)) > 1)).alias("many")).filter("many").drop("many"))
    return (windows.select("s1", "s2", "at", "w1", "w2").join(shared, ["w1", "w2"])
            .groupBy("s1", "s2").agg(F.collect_list(F.struct("at", F.lit(1).alias("n"), "first.id", "first.start")).alias("runs")))


def merged(spans: str) -> F.Column:
    """Union of sorted (start, till) structs as disjoint structs, in order (latest last)."""
    return F.expr(f"""aggregate({spans}, cast(array() as array<struct<start:int,till:int>>), (a, x) ->
        if(size(a) > 0 and x.start <= get(a, size(a) - 1).till,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', get(a, size(a) - 1).start, 'till', greatest(get(a, size(a) - 1).till, x.till)))),
           concat(a, array(x))))""")


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 20, probe: int = 10, m: int = 3) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removed (disjoint word spans, end exclusive),
    kept_sha256 (of the words that stay, joined by one space)."""
    spark = docs.sparkSession
    ship_package(spark)
    src = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    id_type = src.schema["_id"].dataType.simpleString()
    repeated = spark.sparkContext.broadcast(bitmap(_minimiser_counts(src, k, probe), "g", FILTER_BITS))
    packed = materialise(_pack(src, repeated, k, probe, m, id_type).withColumn("row", F.monotonically_increasing_id()), "substring")
    owners = packed.filter("is_doc")
    firsts = _bucket_firsts(packed.filter("not is_doc"), k, id_type)
    places = owners.select("row", "doc_id", F.explode("spans").alias("x")).select("row", "doc_id", "x.s1", "x.s2", F.col("x.start").alias("from"))
    later = (places.join(firsts, ["s1", "s2"]).select("row", "doc_id", "from", F.explode("runs").alias("r"))
             .select("row", (F.col("from") + F.col("r.at")).alias("start"), F.col("r.n").alias("n"),
                     (F.col("doc_id").eqNullSafe(F.col("r.id")) & (F.col("from") + F.col("r.at") == F.col("r.start"))).alias("is_first"))
             .filter("not is_first"))
    gone = later.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + (k - 1)).alias("till")))).alias("removed"))
    gone = gone.select("row", merged("removed").alias("removed"))
    none = "array<struct<start:int,till:int>>"
    table = blank_table()

    @tidy
    def digests(batches):
        for rows, w in text_slices(batches, "text", table):
            removed = rows.column("removed")
            spans, per = removed.flatten(), pc.list_value_length(removed).to_numpy()
            base = np.repeat(w.first[:-1], per)
            start, till = spans.field("start").to_numpy() + base, spans.field("till").to_numpy() + base
            kept = np.ones(len(w.starts), bool)
            kept[ranges(start, till - start)] = False
            whole, o = joined(w, kept)
            out = [hashlib.sha256(whole[x:y]).hexdigest() for x, y in zip(o, o[1:])]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_words"), rows.column("removed"), pa.array(out, pa.string())],
                                             ["doc_id", "n_words", "removed", "kept_sha256"])

    cols = ["doc_id", "n_words", "removed", "text", "sha"]
    touched = (owners.filter("size(spans) > 0").join(gone, "row", "left").withColumn("removed", F.coalesce("removed", F.array().cast(none))).select(cols))
    whole = owners.filter("size(spans) = 0").withColumn("removed", F.array().cast(none)).withColumn("kept_sha256", F.lower(F.hex("sha")))
    out = touched.mapInArrow(digests, f"doc_id {id_type}, n_words long, removed {none}, kept_sha256 string")
    out = out.unionByName(whole.select(out.columns))
    n = F.expr("aggregate(removed, 0L, (a, x) -> a + x.till - x.start)")
    return out.select("doc_id", "n_words", n.alias("n_removed"), "removed", "kept_sha256")
