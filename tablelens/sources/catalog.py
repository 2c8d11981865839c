"""Dataset catalog: append-if-absent recording, history, by-id lookup,
recall, listing.

The catalog holds one row per registered file (metadata, not data), so its
size grows with the number of files, never with rows.  It is stored as a
parquet table; every operation here is a DataFrame transformation."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOG_SCHEMA = ("dataset_id long, file_name string, upload_time timestamp_ntz, rows long, "
                  "columns int, description string")


def empty_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CATALOG_SCHEMA)


def describe_file(df: DataFrame, file_name: str, description: str = "") -> DataFrame:
    """One catalog candidate row for a loaded frame: its row count (one
    aggregate) and column count."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(file_name).alias("file_name"), "rows",
        F.lit(len(df.columns)).alias("columns"), F.lit(description).alias("description"))


def record_datasets(catalog: DataFrame, new: DataFrame, upload_time: _dt.datetime | None = None,
                    refresh: bool = False) -> DataFrame:
    """Append entries whose ``file_name`` is not yet in the catalog; ids
    continue after the current maximum in ``file_name`` order.  An existing
    name keeps its id (and, unless ``refresh``, its old counts)."""
    when = upload_time or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    names = catalog.select("file_name")
    fresh = new.join(names, "file_name", "left_anti").dropDuplicates(["file_name"])
    top = catalog.agg(F.coalesce(F.max("dataset_id"), F.lit(0)).alias("m")).first()["m"]
    # one row per newly registered file: a window over the batch of files
    w = Window.orderBy("file_name")
    added = fresh.select(
        (F.lit(top) + F.row_number().over(w)).cast("long").alias("dataset_id"), "file_name",
        F.lit(when).cast("timestamp_ntz").alias("upload_time"), F.col("rows").cast("long").alias("rows"),
        F.col("columns").cast("int").alias("columns"), F.col("description"))
    kept = catalog
    if refresh:
        upd = new.select("file_name", F.col("rows").alias("n_rows"), F.col("columns").alias("n_cols"))
        kept = (catalog.join(upd, "file_name", "left")
                .select("dataset_id", "file_name", "upload_time",
                        F.coalesce("n_rows", "rows").cast("long").alias("rows"),
                        F.coalesce("n_cols", "columns").cast("int").alias("columns"), "description"))
    return kept.select(*added.columns).unionByName(added)


def dataset_id_of(catalog: DataFrame, file_name: str) -> DataFrame:
    """The id recorded for ``file_name`` (the reference returns the existing
    id on a duplicate insert)."""
    return catalog.filter(F.col("file_name") == file_name).select("dataset_id")


def history(catalog: DataFrame) -> DataFrame:
    return catalog.select("dataset_id", "file_name", "upload_time", "rows", "columns",
                          "description").orderBy("dataset_id")


def by_id(catalog: DataFrame, dataset_id: int) -> DataFrame:
    return history(catalog).filter(F.col("dataset_id") == dataset_id)


def _contains(col: str, text: str):
    # literal, case-insensitive substring: wildcards in the user text are
    # not interpreted (the reference passes them into LIKE unescaped)
    return F.lower(F.col(col)).contains(text.lower())


def recall(catalog: DataFrame, file_id: int | None = None, file_name: str | None = None,
           description: str | None = None) -> DataFrame:
    """By id, else name containing the text, else description containing
    it: first match by lowest id.  No argument lists every dataset."""
    h = history(catalog)
    if file_id:
        return h.filter(F.col("dataset_id") == file_id).limit(1)
    if file_name:
        return h.filter(_contains("file_name", file_name)).limit(1)
    if description:
        return h.filter(_contains("description", description)).limit(1)
    return h


def clean_name(col: str = "file_name"):
    """File name without its extension."""
    return F.regexp_replace(F.col(col), r"\.[^.]*$", "")


def listing(catalog: DataFrame, current_id: int | None = None) -> DataFrame:
    """``(dataset_id, name, rows, columns, is_current)``."""
    cur = F.lit(False) if current_id is None else (F.col("dataset_id") == current_id)
    return history(catalog).select("dataset_id", clean_name().alias("name"), "rows", "columns",
                                   cur.alias("is_current"))
