"""Exact distinct counts of many columns without Spark's Expand rewrite.

Several ``countDistinct`` in one aggregate make Spark replicate every row
once per distinct column (and run every other aggregate on the replicated
rows).  Here values are unpivoted to ``(column, value)`` per type family,
de-duplicated by a partial-aggregated shuffle, and counted per column: one
scan, and a shuffle of at most the distinct values per partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import DATETIME, FRACTIONAL, NUMERIC, as_number, skips_nan


def _as_key(df: DataFrame, c: str) -> tuple[str, Column]:
    dt = df.schema[c].dataType
    col = F.col(c)
    if isinstance(dt, FRACTIONAL):
        v = col.cast("double")
        # -0.0 and 0.0 are one value, as in Spark's grouping
        return "d", F.when(v == 0, F.lit(0.0)).otherwise(v)
    if isinstance(dt, NUMERIC) and not isinstance(dt, T.DecimalType):
        return "l", col.cast("long")
    if isinstance(dt, DATETIME):
        return "l", as_number(df, c).cast("long")
    return "s", col.cast("string")


@skips_nan
def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, distinct)`` with nulls not counted (``countDistinct``).
    One unpivot with one typed slot per family (double / long / string),
    so any mix of column types costs one scan."""
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "column string, distinct long")
    structs = []
    for c in columns:
        fam, e = _as_key(df, c)
        slots = {"d": F.lit(None).cast("double"), "l": F.lit(None).cast("long"), "s": F.lit(None).cast("string")}
        slots[fam] = e
        structs.append(F.struct(F.lit(c).alias("column"), slots["d"].alias("dv"), slots["l"].alias("lv"),
                                slots["s"].alias("sv")))
    long = df.select(F.inline(F.array(*structs)))
    present = F.col("dv").isNotNull() | F.col("lv").isNotNull() | F.col("sv").isNotNull()
    counted = (long.filter(present).distinct()
               .groupBy("column").agg(F.count(F.lit(1)).alias("distinct")))
    # columns that are entirely null have no row above
    names = spark.createDataFrame([(c,) for c in columns], "column string")
    return names.join(counted, "column", "left").select(
        "column", F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"))
