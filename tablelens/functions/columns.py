"""Column classes and the one definition of a missing value."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
           T.FloatType, T.DoubleType, T.DecimalType)
FRACTIONAL = (T.FloatType, T.DoubleType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _field(df: DataFrame, name: str) -> T.StructField:
    for f in df.schema.fields:
        if f.name == name:
            return f
    raise KeyError(f"column {name!r} not in {df.columns}")


def is_category(field: T.StructField) -> bool:
    return bool(field.metadata.get("category", False))


def numeric_columns(df: DataFrame) -> list[str]:
    """pandas ``select_dtypes('number')``: booleans excluded."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def stat_categorical_columns(df: DataFrame) -> list[str]:
    """Categorical for statistics: object, category and bool."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def plot_categorical_columns(df: DataFrame) -> list[str]:
    """Categorical for plots and cleaning: object and category, no bool."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def text_columns(df: DataFrame) -> list[str]:
    """Free text: strings not flagged as category."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and not is_category(f)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME)]


def datetime_named_columns(df: DataFrame) -> list[str]:
    """Columns whose *name* contains ``date`` or ``time`` (any case)."""
    return [c for c in df.columns if "date" in c.lower() or "time" in c.lower()]


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN for float columns (pandas ``isnull``)."""
    c = F.col(name)
    if isinstance(_field(df, name).dataType, FRACTIONAL):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN as null, which built-in aggregates skip."""
    c = F.col(name)
    return F.when(~F.isnan(c), c) if isinstance(_field(df, name).dataType, FRACTIONAL) else c


def skips_nan(fn):
    """For operators whose result holds no rows of their frame: they see NaN as null, as the
    one definition of a missing value says."""
    @wraps(fn)
    def call(df: DataFrame, *args, **kwargs):
        return fn(nan_to_null(df), *args, **kwargs)
    return call


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in float columns so built-in aggregates skip them."""
    if not any(isinstance(f.dataType, FRACTIONAL) for f in df.schema.fields):
        return df
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, FRACTIONAL):
            cols.append(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name, metadata=f.metadata))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def ntz_micros(c: Column) -> Column:
    """Wall-clock microseconds since 1970-01-01 of a ``timestamp_ntz``,
    by arithmetic on its fields (independent of the session time zone)."""
    secs = F.date_part(F.lit("SECOND"), c).cast("decimal(9,6)")
    return (F.unix_date(F.to_date(c)).cast("long") * F.lit(86_400_000_000)
            + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * F.lit(1_000_000)
            + (secs * 1_000_000).cast("long"))


def micros_to_ntz(micros: Column) -> Column:
    """Inverse of :func:`ntz_micros` (interval arithmetic, no time zone)."""
    epoch = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


def as_number(df: DataFrame, name: str) -> Column:
    """Numeric view of a column: datetimes as epoch microseconds (wall
    clock for ``timestamp_ntz`` and dates, instant for ``timestamp``)."""
    dt = _field(df, name).dataType
    if isinstance(dt, T.DateType):
        return (F.unix_date(F.col(name)).cast("long") * F.lit(86_400_000_000)).cast("double")
    if isinstance(dt, T.TimestampNTZType):
        return ntz_micros(F.col(name)).cast("double")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(F.col(name)).cast("double")
    return present(df, name).cast("double")


def validate(df: DataFrame, *names: str | None) -> None:
    for n in names:
        if n is not None and n not in df.columns:
            raise KeyError(f"column {n!r} not in {df.columns}")
