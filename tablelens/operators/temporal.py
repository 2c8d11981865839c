"""Datetime conversion and feature extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import DATETIME

# Formats tried in order when parsing strings, and the feature
# names with the default feature list (``second`` is not a default).
DATETIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm",
                    "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy")
DEFAULT_FEATURES = ("year", "month", "day", "hour", "minute", "dayofweek", "dayofyear",
                    "weekofyear", "quarter")
FEATURES = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour,
    "minute": F.minute, "second": F.second,
    "dayofweek": F.weekday,      # Monday = 0 .. Sunday = 6
    "dayofyear": F.dayofyear,
    "weekofyear": F.weekofyear,  # ISO week
    "quarter": F.quarter,
}


def parse_datetime(c: Column, formats=DATETIME_FORMATS) -> Column:
    """First format that parses, as ``timestamp_ntz``; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats]).cast("timestamp_ntz")


def to_datetime(df: DataFrame, column: str, errors: str = "coerce",
                formats=DATETIME_FORMATS) -> DataFrame:
    """Convert ``column`` to ``timestamp_ntz``.

    ``coerce``: unparseable values become null.  ``raise``: the job fails on
    the first unparseable value (checked lazily inside the same scan).
    ``ignore``: the column is left as is if any value fails (one aggregate).
    An unknown column or an already-datetime column is returned unchanged."""
    if column not in df.columns:
        return df
    dt = df.schema[column].dataType
    if isinstance(dt, DATETIME):
        return df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    src = F.col(column).cast("string")
    parsed = parse_datetime(src, formats)
    failed = src.isNotNull() & parsed.isNull()
    if errors == "coerce":
        return df.withColumn(column, parsed)
    if errors == "raise":
        return df.withColumn(column, F.when(failed, F.raise_error(
            F.concat(F.lit(f"unparseable datetime in {column}: "), src))).otherwise(parsed))
    if errors == "ignore":
        bad = df.agg(F.max(failed.cast("int")).alias("bad")).first()["bad"]
        return df if bad else df.withColumn(column, parsed)
    raise ValueError(f"errors must be coerce, raise or ignore, not {errors!r}")


def extract_datetime_features(df: DataFrame, column: str, features=None) -> DataFrame:
    """Add ``<column>_<feature>`` columns; non-datetime or unknown column is
    returned unchanged, unknown feature names are skipped."""
    if column not in df.columns or not isinstance(df.schema[column].dataType, DATETIME):
        return df
    feats = [f for f in (features or DEFAULT_FEATURES) if f in FEATURES]
    return df.withColumns({f"{column}_{f}": FEATURES[f](F.col(column)) for f in feats})
