"""CSV records of files with quoted line breaks, read by many tasks.

Whether a line break ends a record depends on whether a quoted field is
open there, and that on every line before.  But what one line does is a
small function: the state (field open or not) before it gives the state behind it.
Such functions compose, so a prefix scan settles all states:

1. the lines of each byte range (a split of the ``text`` source) are composed into
   one function; there is one row per range;
2. a window over the ranges of each file gives the state that each begins with;
3. ranges are read again, and lines are joined to records where no field is
   open.  A record within a range is complete; of one that lies across ranges each
   range gives a piece, and pieces are grouped by file and record.

No range waits for another, and a record is all that ever lies in one group.  Line
breaks within fields come out as ``\\n``, however the file writes them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.session import ship_package, written

#: Ranges whose states may be broadcast (about 100 bytes each); beyond it, lines are sorted back into order after a join.
MOST_BROADCAST = 100_000
_COMPLETE, _HEAD, _TAIL = 0, 1, 2


def open_quote(line: Column, sep: str) -> Column:
    """Does a quoted field begin on this line that doesn't end on it?  Doubled quotes go first, then whole quoted fields."""
    begin = rf"(^|\Q{sep}\E)"
    return F.regexp_replace(F.replace(line, F.lit('""'), F.lit("")), rf'{begin}"[^"]*+"', "$1").rlike(rf'{begin}"')


def _lines(spark: SparkSession, files, encoding: str, sep: str) -> DataFrame:
    """(file, start, line, after_closed, after_open): lines in the order of their range, the state behind each
    when no field is open before it, and when one is."""
    text = spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    line = F.regexp_replace("value", "\r$", "") if encoding.upper() == "UTF-8" else F.regexp_replace(F.decode(F.col("value").cast("binary"), encoding), "\r$", "")
    text = text.select("file", "start", line.alias("line"))
    return text.select("*", open_quote(F.col("line"), sep).alias("after_closed"), open_quote(F.concat(F.lit('"'), "line"), sep).alias("after_open"))


def _runs(batch: pa.RecordBatch):
    """(first, last + 1) of the batch's runs of one range."""
    start = batch.column("start").to_numpy()
    code = batch.column("file").dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((start[1:] != start[:-1]) | (code[1:] != code[:-1])) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    return zip(edges, edges[1:], strict=False)


def _bools(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def states(closed: np.ndarray, opened: np.ndarray, before: bool) -> np.ndarray:
    """The state behind each line: constant lines set it, others keep or flip it."""
    n = len(closed)
    flips = np.append(0, np.cumsum(~opened & closed))
    fixed = np.maximum.accumulate(np.where(closed == opened, np.arange(1, n + 1), 0))  # number of the last constant line, from 1
    base = np.where(fixed > 0, closed[np.maximum(fixed - 1, 0)], before)
    return base ^ ((flips[1:] - flips[fixed]) % 2 == 1)


def range_functions(lines: DataFrame) -> DataFrame:
    """(file, start, after_closed, after_open): each range as one line."""
    def run(batches):
        at, now = None, None
        for batch in batches:
            for i, j in _runs(batch) if batch.num_rows else ():
                key = (batch.column("file")[i].as_py(), batch.column("start")[i].as_py())
                if key != at:
                    if at:
                        yield row(at, now)
                    at, now = key, (False, True)
                closed, opened = (_bools(batch.column(c).slice(i, j - i)) for c in ("after_closed", "after_open"))
                now = tuple(bool(states(closed, opened, s)[-1]) for s in now)
        if at:
            yield row(at, now)

    def row(at, now):
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, *now)], ["file", "start", "after_closed", "after_open"])

    return lines.drop("line").mapInArrow(run, "file string, start long, after_closed boolean, after_open boolean")


def range_states(ranges: DataFrame) -> DataFrame:
    """(file, start, open): is a field open where the range begins?  One row per range, a window per file."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    flip = F.col("after_closed") & ~F.col("after_open")
    out = ranges.withColumn("flips", F.sum(flip.cast("int")).over(upto))
    last = F.last(F.when(F.col("after_closed") == F.col("after_open"), F.struct("after_closed", "flips")), ignorenulls=True).over(before)
    out = out.select("file", "start", (F.coalesce(F.sum(flip.cast("int")).over(before), F.lit(0))).alias("flips"), last.alias("last"))
    since = F.col("flips") - F.coalesce("last.flips", F.lit(0))
    return out.select("file", "start", (F.coalesce("last.after_closed", F.lit(False)) != (since % 2 == 1)).alias("open"))


_NAMES = ["file", "start", "kind", "header", "record"]
_SCHEMA = "file string, start long, kind int, header boolean, record string"


class _Range:
    """Records of one range: complete ones, and the pieces of those that lie across ranges."""

    def __init__(self, file: str, start: int, state: bool):
        self.file, self.start, self.state = file, start, state
        self.held: list[str] = []  # lines of the open record
        self.kind = _HEAD if state else _TAIL  # of the piece that they are
        self.headless = start == 0  # the file's first record, its header, is still to come

    def _batch(self, texts: pa.Array, kind: int) -> pa.RecordBatch:
        header = np.zeros(len(texts), bool)
        if self.headless:
            filled = np.flatnonzero(pc.not_equal(pc.utf8_trim_whitespace(texts), "").to_numpy(zero_copy_only=False))
            if len(filled):
                header[filled[0]], self.headless = True, False
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array([self.file] * n, pa.string()), pa.array(np.full(n, self.start)), pa.array(np.full(n, kind, np.int32)),
                                           pa.array(header), texts], _NAMES)

    def add(self, lines: pa.Array, closed: np.ndarray, opened: np.ndarray):
        after = states(closed, opened, self.state)
        self.state = bool(after[-1])
        ends = np.flatnonzero(~after)  # lines that end a record
        at = 0
        if len(ends) and (self.held or self.kind == _HEAD):
            at = int(ends[0]) + 1
            text = "\n".join([*self.held, *lines.slice(0, at).to_pylist()])
            yield self._batch(pa.array([text]), _HEAD if self.kind == _HEAD else _COMPLETE)
            self.held, self.kind, ends = [], _TAIL, ends[1:]
        if len(ends):
            begins = np.concatenate([[0], ends + 1 - at]).astype(np.int32)
            yield self._batch(pc.binary_join(pa.ListArray.from_arrays(pa.array(begins), lines.slice(at, int(begins[-1]))), "\n"), _COMPLETE)
            at += int(begins[-1])
        self.held += lines.slice(at).to_pylist()

    def close(self):
        if self.held:
            yield self._batch(pa.array(["\n".join(self.held)]), self.kind)


def _assemble(batches):
    now = None
    for batch in batches:
        for i, j in _runs(batch) if batch.num_rows else ():
            file, start = batch.column("file")[i].as_py(), batch.column("start")[i].as_py()
            if now is None or (now.file, now.start) != (file, start):
                if now:
                    yield from now.close()
                now = _Range(file, start, bool(batch.column("open")[i].as_py()))
            part = batch.slice(i, j - i)
            yield from now.add(part.column("line"), _bools(part.column("after_closed")), _bools(part.column("after_open")))
    if now:
        yield from now.close()


def records(spark: SparkSession, files, encoding: str = "UTF-8", sep: str = ",", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``record``: the text of every record of the CSV files but each file's first, in no particular order."""
    ship_package(spark)
    lines = _lines(spark, files, encoding, sep)
    ranges = written(range_functions(lines), "csv-ranges")
    begin = range_states(ranges)
    if ranges.count() <= most_broadcast:
        placed = lines.join(F.broadcast(begin), ["file", "start"])  # streams the lines in their order
    else:
        numbered = lines.withColumn("no", F.monotonically_increasing_id()).join(begin, ["file", "start"])
        placed = numbered.repartition("file", "start").sortWithinPartitions("file", "start", "no").drop("no")
    pieces = placed.select("file", "start", "open", "line", "after_closed", "after_open").mapInArrow(_assemble, _SCHEMA)
    pieces = written(pieces, "csv-records")
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    across = pieces.filter(F.col("kind") != _COMPLETE).withColumn("no", F.sum((F.col("kind") == _TAIL).cast("int")).over(order))
    joined = (across.groupBy("file", "no").agg(F.max("header").alias("header"), F.sort_array(F.collect_list(F.struct("start", "kind", "record"))).alias("parts"))
              .select("header", F.array_join(F.transform("parts", lambda x: x["record"]), "\n").alias("record")))
    every = pieces.filter(F.col("kind") == _COMPLETE).select("header", "record").unionByName(joined)
    return every.filter(~F.col("header") & (F.trim("record") != "")).select("record")
