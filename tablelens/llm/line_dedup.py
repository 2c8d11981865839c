"""Line dedup over overlapping three-line windows.

The lines of a text are its ``\\n``-split parts; those with something besides
blanks count, trimmed of blanks, and every ``lines`` consecutive counting lines
of a document are a window.  A window that also occurs earlier (smaller
document id, or the same document further up) is a repeat, and the counting
lines under any repeat are removed.  Blank lines stay where they are.

Null and empty texts, and texts of fewer counting lines than a window, have no
window and stay as they are.  Rows that repeat with the same id and text are
one document: they get the same result; rows of one id and different texts are
different documents, in the order of their digests.  A null id comes after all others.

Two shuffles of window digests (the first one combined on the map side) find
the repeats; a window held by any share of all rows is one row there, and the
join back to its places is an ordinary join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def _places(text: Column) -> Column:
    """Positions of the counting lines among all lines."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.when(_trimmed(x) != "", i)), lambda i: i.isNotNull())


def _digests(text: Column, k: int) -> Column:
    """Digest of each window, in order."""
    def windows(h: Column) -> Column:
        return F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: F.unhex(F.md5(F.concat(
            *[F.element_at(h, (i + j).cast("int")) for j in range(k)])))))

    lines = F.filter(F.transform(F.split(text, "\n"), _trimmed), lambda x: x != "")
    return let(F.transform(lines, lambda x: F.unhex(F.md5(x))), windows)


def _key(doc_id: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))))


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = 3) -> DataFrame:
    """(key, starts): for each document with repeats, the counting lines at which repeated windows begin."""
    k, t = F.col(doc_id), F.col(text)
    places = (docs.filter(t.isNotNull())
              .select(_key(k, t).alias("key"), k.isNull().alias("no_id"), k.alias("id"), F.posexplode(_digests(t, lines)).alias("start", "w"))
              .select("key", "w", F.struct("no_id", "id", "key", "start").alias("at")))
    firsts = places.groupBy("w").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter(F.col("first") < F.col("last"))
    return (places.join(firsts.select("w", "first"), "w").filter(F.col("at") > F.col("first"))
            .groupBy("key").agg(F.collect_set("at.start").alias("starts")))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lines: int = 3,
                total: str = "lines_total", removed: str = "lines_removed") -> DataFrame:
    """``docs`` with ``text`` rid of repeats, and the numbers of counting lines before and removed, replacing columns of these names."""
    key = _key(F.col(doc_id), F.col(text))
    repeats = repeated_windows(docs, doc_id, text, lines)
    joined = docs.withColumn("_tl_key", key).join(repeats.select(F.col("key").alias("_tl_key"), F.col("starts").alias("_tl_starts")), "_tl_key", "left")
    gone = F.array_distinct(F.flatten(F.transform("_tl_starts", lambda s: F.sequence(s, s + (lines - 1)))))

    def without(places: Column) -> Column:
        # positions among all lines of the removed counting lines, as a sorted list
        bad = F.transform(F.sort_array(gone), lambda g: F.element_at(places, (g + 1).cast("int")))
        return F.array_except(F.sequence(F.lit(0), F.size(F.split(text, "\n")) - 1), bad)

    keep = let(_places(F.col(text)), without)
    rebuilt = let(F.split(text, "\n"), lambda all_lines: F.array_join(F.transform(keep, lambda i: F.element_at(all_lines, (i + 1).cast("int"))), "\n"))
    changed = F.col("_tl_starts").isNotNull()
    out = joined.withColumns({
        "_tl_total": F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: _trimmed(x) != "")), F.lit(0)),
        "_tl_removed": F.when(changed, F.size(gone)).otherwise(0),
        "_tl_text": F.when(changed, rebuilt).otherwise(F.col(text))})
    same = [F.col("_tl_text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c.lower() not in (total, removed)]
    return out.select(*same, F.col("_tl_total").alias(total), F.col("_tl_removed").alias(removed))
