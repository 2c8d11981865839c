"""Ad-hoc query surface: SQL with a row cap, head/tail/sample, filter and
project, group-by mean, top-N, value counts, column rename."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tablelens.functions.columns import skips_nan, validate

# Default row cap of a query answer, and the declared rename map.
MAX_ROWS = 30
COLUMN_NAME_MAPPING = {"strange_col1": "customer_id", "weird_col2": "order_date"}


def _keys(order_by) -> list[Column]:
    if isinstance(order_by, (str, Column)):
        order_by = [order_by]
    return [F.col(k) if isinstance(k, str) else k for k in order_by]


def query(spark: SparkSession, df: DataFrame, sql: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Run ``sql`` against ``df`` (referenced as ``{df}``) and cap the answer
    at ``max_rows`` rows.  The cap is a plan-level ``LIMIT`` so Catalyst
    pushes it down; a scalar answer is simply a one-row frame."""
    return spark.sql(sql, df=df).limit(max_rows)


def try_query(spark: SparkSession, df: DataFrame, sql: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Like :func:`query` but an invalid query yields a one-row ``error`` frame."""
    try:
        return query(spark, df, sql, max_rows)
    except (AnalysisException, Exception) as exc:  # parse errors surface here too
        msg = str(exc).strip().splitlines()[0] if str(exc).strip() else type(exc).__name__
        return spark.createDataFrame([(f"Error executing query: {msg}",)], "error string")


def head(df: DataFrame, n: int = 5, order_by="__none__") -> DataFrame:
    """First ``n`` rows by an explicit key (Spark rows have no stored order).
    Sort + limit plans as ``TakeOrderedAndProject``: a per-partition top-n."""
    if order_by == "__none__":
        raise ValueError("head needs an order_by key: DataFrame rows have no order")
    return df.orderBy(*_keys(order_by)).limit(n)


def tail(df: DataFrame, n: int = 5, order_by="__none__") -> DataFrame:
    """Last ``n`` rows by the key, returned in ascending key order."""
    if order_by == "__none__":
        raise ValueError("tail needs an order_by key")
    keys = _keys(order_by)
    return df.orderBy(*[k.desc() for k in keys]).limit(n).orderBy(*keys)


def sample(df: DataFrame, n: int, key, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, repeatable: the ``n`` smallest seeded row hashes."""
    keys = _keys(key)
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def filter_project(df: DataFrame, predicate, columns: list[str]) -> DataFrame:
    validate(df, *columns)
    pred = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.filter(pred).select(*columns)


@skips_nan
def groupby_agg(df: DataFrame, by: str, value: str, func: str = "mean",
                alias: str | None = None) -> DataFrame:
    """``df.groupby(by)[value].<func>()``: null keys dropped as pandas does."""
    validate(df, by, value)
    fn = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max,
          "count": F.count, "median": F.median, "std": F.stddev_samp}[func]
    return (df.filter(F.col(by).isNotNull()).groupBy(by)
            .agg(fn(value).alias(alias or f"{func}_{value}")))


@skips_nan
def top_n(df: DataFrame, by: str, value: Column | str, n: int = 10,
          agg: str = "sum", alias: str = "total", ndigits: int | None = 2) -> DataFrame:
    """Top ``n`` groups by an aggregate, ties broken by key ascending."""
    v = F.col(value) if isinstance(value, str) else value
    fn = {"sum": F.sum, "mean": F.avg, "count": F.count, "max": F.max}[agg]
    out = fn(v)
    if ndigits is not None:
        out = F.round(out, ndigits)
    return (df.filter(F.col(by).isNotNull()).groupBy(by).agg(out.alias(alias))
            .orderBy(F.col(alias).desc(), F.col(by)).limit(n))


@skips_nan
def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """``value_counts``: descending count, nulls dropped, ties by value."""
    validate(df, column)
    out = (df.filter(F.col(column).isNotNull()).groupBy(column).count()
           .orderBy(F.col("count").desc(), F.col(column)))
    return out.limit(n) if n else out


def nunique(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, distinct)``: exact distinct counts, nulls not counted."""
    from tablelens.plans.distinct import distinct_counts
    return distinct_counts(df, columns or df.columns)


def rename_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename by mapping; names absent from the frame are ignored."""
    mapping = COLUMN_NAME_MAPPING if mapping is None else mapping
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})
