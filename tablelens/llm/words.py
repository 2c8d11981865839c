"""Vectorised words of Arrow text columns, and small Spark helpers for this package.

A batch of texts is one byte buffer with offsets.  Word classes here are
ASCII-only classes (every byte of a non-ASCII character is a word byte), so
splitting bytes equals splitting code points.
"""

from __future__ import annotations

from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.session import scratch_path

#: Text bytes that one numpy step works on; a longer document is one step of its own.
SLICE_BYTES = 1 << 20
U64 = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so invertible modulo 2**64


def blank_table() -> np.ndarray:
    """Words are runs of anything but space and 0x09-0x0D; case is kept."""
    t = np.arange(256, dtype=np.int16)
    t[[0x20, *range(0x09, 0x0E)]] = -1
    return t


def folded(table: np.ndarray) -> np.ndarray:
    """The same class with A-Z as a-z."""
    t = table.copy()
    t[0x41:0x5B] = np.where(table[0x41:0x5B] < 0, -1, np.arange(0x61, 0x7B))
    return t


def alnum_table() -> np.ndarray:
    """Words are runs of 0-9, a-z, A-Z (as a-z) and non-ASCII characters."""
    t = np.full(256, -1, np.int16)
    for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        t[lo:hi] = np.arange(lo, hi)
    return folded(t)


@cache
def _byte_values(table: bytes, seed: int) -> np.ndarray:
    t = np.frombuffer(table, np.int16)
    values = np.random.default_rng(1000 + seed).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
    return np.where(t < 0, U64(0), values[np.maximum(t, 0)])


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """First n powers of the seed's multiplier (or its inverse) modulo 2**64."""
    have = _POWERS.get((seed, inverse))
    if have is None or len(have) < n:
        base = _ODD[seed] if not inverse else pow(_ODD[seed], -1, 1 << 64)
        m = max(n, 1 << 16)
        p = np.full(m, base, U64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if m <= SLICE_BYTES:  # a longer document's powers are not kept
            _POWERS[seed, inverse] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(29))


class Words:
    """Words of some texts: byte spans, words per text, 64-bit hashes by seed."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray):
        self.data, self.offs, self.table = data, offs, table
        n = len(data)
        m = (table >= 0)[data] if n else np.zeros(0, bool)
        st, en = m.copy(), m.copy()
        if n:
            st[1:] &= ~m[:-1]
            en[:-1] &= ~m[1:]
            full = offs[1:] > offs[:-1]
            a, b = offs[:-1][full], offs[1:][full] - 1
            st[a], en[b] = m[a], m[b]
        self.starts, self.ends = np.flatnonzero(st), np.flatnonzero(en) + 1
        self.first = np.searchsorted(self.starts, offs)  # word index at which each text begins; one more at the end
        self._h: dict[int, np.ndarray] = {}

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        if seed not in self._h:
            if len(self.starts) == 0:
                self._h[seed] = np.zeros(0, U64)
            else:
                n = len(self.data)
                c = _byte_values(self.table.tobytes(), seed)[self.data]
                c *= powers(n, seed)
                s = np.add.reduceat(c, self.starts)
                # a word that ends where its text ends is followed by bytes of the next text's separators only
                self._h[seed] = mix(s * powers(n, seed, True)[self.starts] + U64(seed))
        return self._h[seed]

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)

    def room(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def windows(self, k: int, seed: int = 0) -> np.ndarray:
        """Hash of the k words from each word on (meaningless where room() < k)."""
        return window_hashes(self.hashes(seed), k, seed)


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    n = len(h)
    if n == 0:
        return np.zeros(0, U64)
    s = np.zeros(n + 1, U64)
    np.cumsum(h * powers(n, 1 - seed), out=s[1:])
    end = np.minimum(np.arange(n) + k, n)
    return mix((s[end] - s[:-1]) * powers(n, 1 - seed, True) + U64(k))


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the words in each span [start, end)."""
    n = len(h)
    if n == 0 or len(starts) == 0:
        return np.zeros(len(starts), U64)
    s = np.zeros(n + 1, U64)
    np.cumsum(h * powers(n, 1 - seed), out=s[1:])
    return mix((s[ends] - s[starts]) * powers(n, 1 - seed, True)[starts] + (ends - starts).astype(U64))


def sliding(op, x: np.ndarray, k: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over x[i:i+k]; the last ones see fewer values."""
    out, done = x.copy(), 1
    while done < k:
        step = min(done, k - done)
        out[:-step] = op(out[:-step], out[step:]) if step < len(out) else out[:-step]
        done += step
    return out


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_binary()), b"")
    _, o, d = arr.buffers()
    offs = np.frombuffer(o, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, most: int = SLICE_BYTES):
    """(first row, last row + 1, bytes, offsets) of runs of rows of at most ``most`` bytes, or one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def text_slices(batches, column: str, table: np.ndarray, most: int = SLICE_BYTES):
    """(rows as a RecordBatch, their Words) over Arrow batches, in bounded steps."""
    for batch in batches:
        if batch.num_rows:
            for i, j, d, o in slices(*buffers(batch.column(column)), most):
                yield batch.slice(i, j - i), Words(d, o, table)


def give_back() -> None:
    """Freed memory goes back to the system: a worker lives on after its task, beside the next stage."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A batch function that gives its memory back at the end of its task."""
    @wraps(run)
    def call(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return call


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), values)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... start + count - 1, one after another."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


def take_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte spans as a binary column."""
    n = ends - starts
    offs = np.zeros(len(n) + 1, np.int32)
    np.cumsum(n, out=offs[1:])
    out = data[ranges(starts, n)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(out))])


def joined(w: Words, kept: np.ndarray | None = None) -> tuple[memoryview, list[int]]:
    """Words of each text (those that ``kept`` marks) joined by one space: all bytes, and each text's offsets."""
    kept = np.ones(len(w.starts), bool) if kept is None else kept
    last = np.zeros(len(w.starts), bool)
    k = np.flatnonzero(kept)
    doc = w.doc_of()[k]
    last[k[np.append(doc[1:] != doc[:-1], True)] if len(k) else k] = True
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[w.starts[k]] += 1
    edge[w.ends[k]] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    data = w.data.copy()
    gaps = w.ends[kept & ~last]  # a later word of the text is kept, so a blank follows
    mask[gaps], data[gaps] = True, 0x20
    return memoryview(data[mask]), np.append(0, np.cumsum(mask))[w.offs].tolist()


def i64(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


# ------------------------------------------------------------- Spark helpers

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: later reads don't depend on the executors that made it.
    ``batch_rows``: rows of an Arrow batch while this is written, for rows that hold much text."""
    spark = df.sparkSession
    path = f"{scratch_path(spark, name)}/t"
    before = spark.conf.get(_ROWS)
    try:
        if batch_rows:
            spark.conf.set(_ROWS, str(batch_rows))
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A filter of 2**bits bits, two set per value, over a column of 64-bit hashes: fixed size
    whatever the rows.  The driver gets at most 2**(bits-6) words of it; false positives are for
    the caller to verify."""
    both = df.select(F.explode(F.array(F.col(column), F.shiftrightunsigned(F.col(column), 32))).alias("h"))
    words = (both.select(F.shiftright(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int").alias("w"),
                         F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(1 << (bits - 6), U64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(U64)
    return out


def in_bitmap(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    def probe(x):
        x = x & U64(len(words) * 64 - 1)
        return (words[x >> U64(6)] >> (x & U64(63))) & U64(1) != 0

    out = probe(h)
    at = np.flatnonzero(out)
    out[at] = probe(h[at] >> U64(32))
    return out
