"""Profiling: describe, column summary, top values, missing report, numeric
and string profiles, data-quality alerts, outliers, recommendations, digest.

All per-column statistics of a table come from one wide aggregate; the
one-row result is turned into one row per column with ``inline`` (no
per-column re-scan as in the reference)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import (DATETIME, FRACTIONAL, NUMERIC, datetime_named_columns,
                                         is_missing, micros_to_ntz, ntz_micros, numeric_columns, present,
                                         skips_nan, stat_categorical_columns, validate)
from tablelens.plans.distinct import distinct_counts
from tablelens.plans.quantiles import quantiles

# Alert thresholds (defaults of the profiling library the
# reference delegates to) and the quartile set of ``describe``.
SKEWNESS_THRESHOLD = 20.0
HIGH_CARDINALITY = 50
ZEROS_SHARE = 0.05
MOSTLY_MISSING_SHARE = 0.5
DESCRIBE_PROBS = (0.25, 0.5, 0.75)
PROFILE_PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)
TOP_VALUES = 10

# The six recommendation rules of the reference, in order:
# (rule_no, type, priority, description, suggestion).  ``{n}`` is the
# number of columns with missing values, ``{cat}`` / ``{num}`` the first
# categorical / numeric column, ``{dates}`` the date/time-named columns.
RECOMMENDATION_RULES = (
    (1, "data_cleaning", "high", "Missing values found in {n} columns",
     "Consider imputation techniques (mean, median, mode) or removal of missing values"),
    (2, "analysis", "medium", "Numerical columns present in dataset",
     "Perform outlier detection using box plots or z-scores"),
    (3, "feature_engineering", "medium", "Dataset has multiple features",
     "Consider creating interaction terms or polynomial features for machine learning"),
    (4, "machine_learning", "high", "Dataset has both numerical and categorical features",
     "Consider building a predictive model for classification on '{cat}', regression on '{num}' "
     "using algorithms like Random Forest or Gradient Boosting"),
    (5, "time_series", "high", "Date/time columns detected: {dates}",
     "Perform time series analysis to identify trends, seasonality, and patterns over time"),
    (6, "dimensionality_reduction", "medium", "Dataset has a high number of features",
     "Apply dimensionality reduction techniques like PCA or t-SNE to visualize high-dimensional data"),
)


def _method(approx: bool) -> str:
    return "approx" if approx else "exact"


@skips_nan
def describe(df: DataFrame, columns: list[str] | None = None, approx: bool = False,
             ndigits: int = 4) -> DataFrame:
    """pandas ``describe()`` of numeric columns, one row per column:
    ``(column, count, mean, std, min, p25, p50, p75, max)``.  Quartiles are
    exact (linear interpolation) unless ``approx``."""
    cols = columns or numeric_columns(df)
    validate(df, *cols)
    # quantiles stay in their own aggregate: in the same aggregate they would
    # force an object hash aggregate and take the moments out of codegen
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.select(*cols).agg(*aggs)
    r = lambda e: F.round(e, ndigits)
    mom = row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), r(F.col(f"m{i}")).alias("mean"),
                 r(F.col(f"s{i}")).alias("std"), r(F.col(f"lo{i}")).alias("min"), r(F.col(f"hi{i}")).alias("max"))
        for i, c in enumerate(cols)])))
    q = quantiles(df, cols, DESCRIBE_PROBS, method=_method(approx))
    return mom.join(q, "column").select("column", "count", "mean", "std", "min", r(F.col("q")[0]).alias("p25"),
                                        r(F.col("q")[1]).alias("p50"), r(F.col("q")[2]).alias("p75"), "max")


def schema_profile(df: DataFrame) -> DataFrame:
    """Schema listing with row and column counts: ``(position, column,
    dtype, rows, columns)``; the only action-free parts are the schema."""
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string")
    n = df.agg(F.count(F.lit(1)).alias("rows"))
    r = n.first()["rows"]
    return meta.select("*", F.lit(r).cast("long").alias("rows"), F.lit(len(df.columns)).alias("columns"))


def dtype_tally(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    tally: dict[str, int] = {}
    for f in df.schema.fields:
        tally[f.dataType.simpleString()] = tally.get(f.dataType.simpleString(), 0) + 1
    return spark.createDataFrame(sorted(tally.items()), "dtype string, columns long")


def _micros(c: str) -> Column:
    return ntz_micros(F.col(c).cast("timestamp_ntz")).cast("double")


def _from_micros(e: Column) -> Column:
    return micros_to_ntz(F.floor(e).cast("long"))


@skips_nan
def column_summary(df: DataFrame, approx: bool = False, ndigits: int = 4) -> DataFrame:
    """Per column: dtype, distinct, missing count and % (2 dp); numeric
    columns add min/max/mean/median, datetime columns the same as
    timestamps.  ``(column, dtype, distinct_count, missing_count,
    missing_pct, min_value, max_value, mean_value, median_value, min_time,
    max_time, mean_time, median_time)``."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        c = f.name
        aggs += [F.count(F.when(is_missing(df, c), 1)).alias(f"mi{i}")]
        if isinstance(f.dataType, NUMERIC):
            v = F.col(c).cast("double")
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"m{i}")]
        elif isinstance(f.dataType, DATETIME):
            v = _micros(c)
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"m{i}")]
    qcols = [f.name for f in fields if isinstance(f.dataType, NUMERIC + DATETIME)]
    # medians in their own aggregate (see describe)
    row = df.agg(*aggs)
    med = quantiles(df, qcols, [0.5], method=_method(approx)).select("column", F.col("q")[0].alias("__med"))
    rows = F.nullif(F.col("__rows"), F.lit(0))  # an empty frame has no shares
    null_d, null_t = F.lit(None).cast("double"), F.lit(None).cast("timestamp_ntz")
    structs = []
    for i, f in enumerate(fields):
        num = isinstance(f.dataType, NUMERIC)
        dt = isinstance(f.dataType, DATETIME)
        rd = lambda e: F.round(e, ndigits)
        structs.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f"mi{i}").alias("missing_count"),
            F.round(F.col(f"mi{i}") * 100.0 / rows, 2).alias("missing_pct"),
            (rd(F.col(f"lo{i}")) if num else null_d).alias("min_value"),
            (rd(F.col(f"hi{i}")) if num else null_d).alias("max_value"),
            (rd(F.col(f"m{i}")) if num else null_d).alias("mean_value"),
            null_d.alias("median_value"),
            (_from_micros(F.col(f"lo{i}")) if dt else null_t).alias("min_time"),
            (_from_micros(F.col(f"hi{i}")) if dt else null_t).alias("max_time"),
            (_from_micros(F.col(f"m{i}")) if dt else null_t).alias("mean_time"),
            null_t.alias("median_time")))
    out = row.select(F.inline(F.array(*structs)))
    d = distinct_counts(df, [f.name for f in fields]).withColumnRenamed("distinct", "distinct_count")
    out = out.join(d, "column").join(med, "column", "left")
    is_dt = F.col("dtype").isin("timestamp", "timestamp_ntz", "date")
    out = (out.withColumn("median_value", F.when(~is_dt, F.round("__med", ndigits)))
           .withColumn("median_time", F.when(is_dt, _from_micros(F.col("__med")))))
    return out.select("column", "dtype", "distinct_count", *[c for c in out.columns
                                                            if c not in ("column", "dtype", "distinct_count", "__med")])


def top_values(df: DataFrame, columns: list[str] | None = None, n: int = TOP_VALUES) -> DataFrame:
    """Top ``n`` value counts of each string/bool column, nulls dropped:
    ``(column, value, count, rank)``.  One unpivot + one partial-aggregated
    shuffle for all columns; ``rank <= n`` plans as a per-partition group
    limit before the window's shuffle."""
    cols = columns if columns is not None else stat_categorical_columns(df)
    validate(df, *cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, count long, rank int")
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])))
    vc = long.filter(F.col("value").isNotNull()).groupBy("column", "value").count()
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value"))
    return vc.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with at least one missing value: ``(column, missing_count)``."""
    row = df.agg(*[F.count(F.when(is_missing(df, c), 1)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    out = row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"))
        for i, c in enumerate(df.columns)])))
    return out.filter(F.col("missing_count") > 0)


def _power_sum_moments(df: DataFrame, cols: list[str], shift: dict) -> DataFrame:
    """Per column, from power sums of median-shifted values: count, sum,
    mean, variance, std, min, max, sample-free central moments m2..m4,
    zeros and negatives - about ten buffer fields per column, so the
    aggregate stays in whole-stage codegen (Spark's moment aggregates carry
    three to five fields each, per function)."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        y = v - F.lit(float(shift.get(c) or 0.0))
        aggs += [F.count(v).alias(f"n{i}"), F.sum(v).alias(f"su{i}"), F.sum(y).alias(f"a{i}"),
                 F.sum(y * y).alias(f"b{i}"), F.sum(y * y * y).alias(f"c{i}"), F.sum(y * y * y * y).alias(f"d{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 F.count(F.when(v == 0, 1)).alias(f"z{i}"), F.count(F.when(v < 0, 1)).alias(f"neg{i}")]
    row = df.select(*cols).agg(*aggs)
    structs = []
    for i, c in enumerate(cols):
        n = F.nullif(F.col(f"n{i}").cast("double"), F.lit(0.0))  # no moments without values
        e1, e2 = F.col(f"a{i}") / n, F.col(f"b{i}") / n
        e3, e4 = F.col(f"c{i}") / n, F.col(f"d{i}") / n
        m2 = e2 - e1 * e1
        m3 = e3 - 3 * e1 * e2 + 2 * e1 * e1 * e1
        m4 = e4 - 4 * e1 * e3 + 6 * e1 * e1 * e2 - 3 * e1 * e1 * e1 * e1
        structs.append(F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
            (F.col("__rows") - F.col(f"n{i}")).alias("missing"),
            (F.lit(float(shift.get(c) or 0.0)) + e1).alias("mean"),
            F.when(n > 1, F.greatest(m2, F.lit(0.0)) * n / (n - 1)).alias("variance"),
            F.col(f"su{i}").alias("sum"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
            F.when(m2 > 0, m3 / F.pow(m2, 1.5)).alias("g1"), F.when(m2 > 0, m4 / (m2 * m2) - 3).alias("g2"),
            F.col(f"z{i}").alias("zeros"), F.col(f"neg{i}").alias("negatives")))
    return row.select(F.inline(F.array(*structs)))


@skips_nan
def profile_numeric(df: DataFrame, columns: list[str] | None = None, approx: bool = False,
                    ndigits: int = 4) -> DataFrame:
    """Numeric profile per column: count, missing, mean, std, variance, sum,
    min, max, range, p5..p95, IQR, CV, sample skewness, sample excess
    kurtosis, zeros, negatives, distinct, distinct %, is_unique.  Quantiles
    come first (k rows read back); their medians shift the power sums of
    the moment pass; distinct counts come from their own plan."""
    cols = columns or numeric_columns(df)
    validate(df, *cols)
    qt = quantiles(df, cols, PROFILE_PROBS, method=_method(approx))
    qv = {r["column"]: r["q"] for r in qt.collect()}  # k rows of 5 numbers
    shift = {c: (qv.get(c) or [None] * 5)[2] for c in cols}
    qdf = df.sparkSession.createDataFrame([(c, qv.get(c)) for c in cols], "column string, q array<double>")
    mom = _power_sum_moments(df, cols, shift)
    out = mom.join(qdf, "column").join(distinct_counts(df, cols), "column")
    rd = lambda e: F.round(e, ndigits)
    n = F.col("count").cast("double")
    std = F.sqrt(F.col("variance"))
    skew = F.when(n >= 3, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    q = F.col("q")
    return out.select(
        "column", "count", "missing", rd(F.col("mean")).alias("mean"), rd(std).alias("std"),
        rd(F.col("variance")).alias("variance"), rd(F.col("sum")).alias("sum"), rd(F.col("min")).alias("min"),
        rd(F.col("max")).alias("max"), rd(F.col("max") - F.col("min")).alias("range"),
        rd(q[0]).alias("p5"), rd(q[1]).alias("p25"), rd(q[2]).alias("p50"), rd(q[3]).alias("p75"),
        rd(q[4]).alias("p95"), rd(q[3] - q[1]).alias("iqr"),
        rd(F.when(F.col("mean") != 0, std / F.col("mean"))).alias("cv"),
        rd(skew).alias("skewness"), rd(kurt).alias("kurtosis"), "zeros", "negatives",
        "distinct", F.round(F.col("distinct") * 100.0 / F.nullif(F.col("count"), F.lit(0)), 2).alias("distinct_pct"),
        ((F.col("distinct") == F.col("count")) & (F.col("count") > 0)).alias("is_unique"))


def profile_string(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """String profile per column: count, missing, distinct, distinct %,
    is_unique, min / mean / max length."""
    cols = columns if columns is not None else [f.name for f in df.schema.fields
                                                if isinstance(f.dataType, T.StringType)]
    validate(df, *cols)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        ln = F.length(F.col(c))
        aggs += [F.count(F.col(c)).alias(f"n{i}"),
                 F.min(ln).alias(f"lmin{i}"), F.avg(ln).alias(f"lavg{i}"), F.max(ln).alias(f"lmax{i}")]
    row = df.select(*cols).agg(*aggs)
    out = row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
                 (F.col("__rows") - F.col(f"n{i}")).alias("missing"),
                 F.col(f"lmin{i}").alias("min_length"), F.round(F.col(f"lavg{i}"), 4).alias("mean_length"),
                 F.col(f"lmax{i}").alias("max_length"))
        for i, c in enumerate(cols)]))).join(distinct_counts(df, cols), "column")
    return out.select("column", "count", "missing", "distinct",
                      F.round(F.col("distinct") * 100.0 / F.nullif(F.col("count"), F.lit(0)), 2).alias("distinct_pct"),
                      ((F.col("distinct") == F.col("count")) & (F.col("count") > 0)).alias("is_unique"),
                      "min_length", "mean_length", "max_length")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``(rows, distinct_rows, duplicate_rows)``; null equals null as in
    pandas ``duplicated``.  One partial-aggregated shuffle on all columns."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__c"))
    return g.agg(F.sum("__c").cast("long").alias("rows"), F.count(F.lit(1)).alias("distinct_rows")).select(
        F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "distinct_rows",
        (F.coalesce("rows", F.lit(0).cast("long")) - F.col("distinct_rows")).alias("duplicate_rows"))


@skips_nan
def quality_alerts(df: DataFrame) -> DataFrame:
    """Data-quality alerts per column: CONSTANT, UNIQUE, MISSING,
    MOSTLY_MISSING, ZEROS, SKEWED, HIGH_CARDINALITY.  ``(column, alert,
    value)`` where value is the measured share or count behind the alert."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        c = f.name
        aggs += [F.count(F.when(~is_missing(df, c), 1)).alias(f"n{i}")]
        if isinstance(f.dataType, NUMERIC):
            v = F.col(c).cast("double")
            aggs += [F.count(F.when(v == 0, 1)).alias(f"z{i}"), F.skewness(v).alias(f"g1{i}")]
    dist = distinct_counts(df, [f.name for f in fields])
    wide = dist.agg(*[F.max(F.when(F.col("column") == f.name, F.col("distinct"))).alias(f"d{i}")
                      for i, f in enumerate(fields)])
    row = df.agg(*aggs)
    r_d = wide.first()  # one number per column
    row = row.select("*", *[F.lit(r_d[f"d{i}"]).cast("long").alias(f"d{i}") for i in range(len(fields))])
    rows = F.nullif(F.col("__rows").cast("double"), F.lit(0.0))
    alerts = []
    for i, f in enumerate(fields):
        n, d = F.col(f"n{i}").cast("double"), F.col(f"d{i}")
        miss = (rows - n) / rows
        alerts += [
            (f.name, "CONSTANT", d == 1, d.cast("double")),
            (f.name, "UNIQUE", (d == n) & (n > 1), d.cast("double")),
            (f.name, "MISSING", (miss > 0) & (miss <= MOSTLY_MISSING_SHARE), miss),
            (f.name, "MOSTLY_MISSING", miss > MOSTLY_MISSING_SHARE, miss),
        ]
        if isinstance(f.dataType, NUMERIC):
            zs = F.col(f"z{i}") / F.nullif(n, F.lit(0.0))
            skew = F.when(n >= 3, F.col(f"g1{i}") * F.sqrt(n * (n - 1)) / (n - 2))
            alerts += [(f.name, "ZEROS", zs > ZEROS_SHARE, zs),
                       (f.name, "SKEWED", F.abs(skew) > SKEWNESS_THRESHOLD, skew)]
        if isinstance(f.dataType, T.StringType):
            alerts.append((f.name, "HIGH_CARDINALITY", d > HIGH_CARDINALITY, d.cast("double")))
    structs = [F.struct(F.lit(c).alias("column"), F.lit(a).alias("alert"),
                        F.coalesce(cond, F.lit(False)).alias("hit"), F.round(val, 4).alias("value"))
               for c, a, cond, val in alerts]
    return row.select(F.inline(F.array(*structs))).filter("hit").drop("hit")


def outliers_iqr(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows outside [Q1 - k IQR, Q3 + k IQR] (the box-plot fences)."""
    validate(df, column)
    v = present(df, column).cast("double")
    q = quantiles(df, [column], [0.25, 0.75]).first()["q"]
    if q is None:
        return df.limit(0)
    lo, hi = q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])
    return df.filter((v < F.lit(lo)) | (v > F.lit(hi)))


def outliers_zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Rows with |value - mean| / std > threshold (sample std)."""
    validate(df, column)
    v = present(df, column).cast("double")
    r = df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s")).first()
    if r["s"] is None or r["s"] == 0:
        return df.limit(0)
    return df.filter(F.abs(v - F.lit(r["m"])) / F.lit(r["s"]) > threshold)


def recommendations(df: DataFrame, missing: int | None = None) -> DataFrame:
    """The six recommendation rules: ``(rule_no, type, priority,
    description, suggestion)``.  Only the count of columns with missing values needs
    data, unless it is given."""
    spark = df.sparkSession
    nums = numeric_columns(df)
    cats = stat_categorical_columns(df)
    dates = datetime_named_columns(df)
    n_missing = missing_report(df).count() if missing is None else missing
    hit = {1: n_missing > 0, 2: bool(nums), 3: len(df.columns) > 5, 4: bool(cats and nums),
           5: bool(dates), 6: len(df.columns) > 10}
    fill = {"n": n_missing, "cat": cats[0] if cats else "", "num": nums[0] if nums else "",
            "dates": ", ".join(dates)}
    recs = [(no, kind, prio, desc.format(**fill), sug.format(**fill))
            for no, kind, prio, desc, sug in RECOMMENDATION_RULES if hit[no]]
    return spark.createDataFrame(recs, "rule_no int, type string, priority string, description string, suggestion string")


def insight_digest(df: DataFrame) -> DataFrame:
    """``(metric, value)``: rows, columns, columns per dtype, columns with
    missing values, significant relationships, recommendations.

    One scan counts rows and missing values, for the recommendations too; the others are the relationships' own,
    which don't grow with the number of columns."""
    from tablelens.operators.relations import relationships
    spark = df.sparkSession
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.max(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    missing = sum(bool(row[f"m{i}"]) for i in range(len(df.columns)))
    out = [("rows", row["rows"]), ("columns", len(df.columns))]
    out += [(f"dtype:{r['dtype']}", r["columns"]) for r in dtype_tally(df).collect()]
    out.append(("missing_columns", missing))
    out.append(("relationships", relationships(df, None).count()))
    out.append(("recommendations", recommendations(df, missing).count()))
    return spark.createDataFrame(out, "metric string, value long")
