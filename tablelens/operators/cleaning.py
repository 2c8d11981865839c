"""Cleaning: missing-value strategy and imputation, dedupe, type
correction, rare-category collapse, text normalisation, auto-clean.

Every decision that depends on data (strategy, which columns to retype,
which values are rare) comes from ONE aggregate over all columns whose
one-row (or bounded) result is read back; the rewrite is then one
``select``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import (FRACTIONAL, NUMERIC, is_category, is_missing,
                                         numeric_columns, plot_categorical_columns, text_columns)
from tablelens.functions.text import NON_WORD_NON_SPACE, NUMBER_RE, WS_RUN
from tablelens.operators.temporal import DATETIME_FORMATS, parse_datetime
from tablelens.plans.distinct import distinct_counts

# Auto-strategy thresholds, category ratio, rare-category rule.
DROP_BELOW = 0.05
KNN_BELOW = 0.30
CATEGORY_RATIO = 0.5
RARE_SHARE = 0.05
RARE_MAX_DISTINCT = 100
OTHER = "Other"


def missing_strategy(df: DataFrame) -> DataFrame:
    """``(missing_cells, total_cells, missing_share, strategy)``: share of
    missing cells over all columns; <5% drop, <30% knn, else median (an
    empty frame gives median, as 0/0 fails both tests)."""
    total = F.count(F.lit(1)) * F.lit(len(df.columns))
    miss = sum((F.count(F.when(is_missing(df, c), 1)) for c in df.columns), F.lit(0))
    row = df.agg(miss.cast("long").alias("missing_cells"), total.cast("long").alias("total_cells"))
    share = F.when(F.col("total_cells") > 0, F.col("missing_cells") / F.col("total_cells"))
    strat = F.when(share < DROP_BELOW, "drop").when(share < KNN_BELOW, "knn").otherwise("median")
    return row.select("missing_cells", "total_cells", F.round(share, 6).alias("missing_share"),
                      strat.alias("strategy"))


def impute_drop(df: DataFrame) -> DataFrame:
    """Drop rows with any null (or NaN) value."""
    return df.na.drop("any")


def _numeric_fill(df: DataFrame, values: dict[str, float]) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if f.name in values:
            v = F.col(f.name).cast("double")
            fill = values[f.name]
            cols.append(F.when(is_missing(df, f.name), F.lit(fill) if fill is not None else F.lit(None).cast("double"))
                        .otherwise(v).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def impute_simple(df: DataFrame, strategy: str = "mean", columns: list[str] | None = None,
                  approx: bool = False) -> DataFrame:
    """Fill numeric columns with their mean, median or most frequent value
    (``mode`` and ``most_frequent`` are the same; ties take the smallest).
    The k statistics come from one aggregate; the columns become double."""
    cols = columns or numeric_columns(df)
    if not cols:
        return df
    strategy = "most_frequent" if strategy == "mode" else strategy
    if strategy == "median":
        from tablelens.plans.quantiles import quantiles
        med = {r["column"]: (r["q"][0] if r["q"] else None)
               for r in quantiles(df, cols, [0.5], method="approx" if approx else "exact").collect()}
        return _numeric_fill(df, med)
    if strategy == "most_frequent":
        return _numeric_fill(df, most_frequent(df, cols))
    aggs = []
    for i, c in enumerate(cols):
        v = F.when(~is_missing(df, c), F.col(c).cast("double"))
        if strategy == "mean":
            aggs.append(F.avg(v).alias(f"s{i}"))
        elif strategy == "most_frequent":
            continue
        else:
            raise ValueError(f"unsupported strategy {strategy!r}")
    r = df.agg(*aggs).first()
    return _numeric_fill(df, {c: r[f"s{i}"] for i, c in enumerate(cols)})


def most_frequent(df: DataFrame, columns: list[str]) -> dict:
    """Most frequent value of each column, smallest on ties, as
    ``{column: value}``.  Value counts are a distributed, partial-aggregated
    shuffle of (column, value); the top-1 per column is a group-limited
    window, so no single task ever holds a column's value -> count map."""
    from pyspark.sql import Window
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.when(~is_missing(df, c), F.col(c).cast("double")).alias("v"))
        for c in columns]))).filter(F.col("v").isNotNull())
    vc = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("v"))
    top = vc.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") == 1)
    got = {r["column"]: r["v"] for r in top.collect()}  # one row per column
    return {c: got.get(c) for c in columns}


def impute_constant(df: DataFrame, value) -> DataFrame:
    """Fill every type-compatible column with ``value``."""
    return df.na.fill(value)


def handle_missing(df: DataFrame, strategy: str = "auto", fill_value=None,
                   key: str | None = None, k: int = 5) -> DataFrame:
    """The reference's dispatcher; ``auto`` reads the one-row strategy."""
    if strategy == "auto":
        strategy = missing_strategy(df).first()["strategy"]
    if strategy == "drop":
        return impute_drop(df)
    if strategy == "knn":
        from tablelens.operators.knn import impute_knn
        return impute_knn(df, key=key, k=k)
    if strategy in ("mean", "median", "most_frequent", "mode"):
        return impute_simple(df, strategy)
    if strategy == "constant":
        return impute_constant(df, fill_value)
    return df


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed (identical rows, so which one is kept is moot)."""
    return df.dropDuplicates()


def _type_decisions(df: DataFrame, min_parse_ratio: float = 0.0, formats=DATETIME_FORMATS,
                    kinds=("numeric", "datetime", "category")) -> list[tuple[str, str]]:
    """For every string column: 'numeric', 'datetime', 'category' or None,
    decided from one aggregate over all string columns."""
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strs:
        return []
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(strs):
        col = F.col(c)
        aggs += [F.count(col).alias(f"n{i}"),
                 F.count(F.when(col.rlike(NUMBER_RE), 1)).alias(f"num{i}"),
                 F.count(parse_datetime(col, formats)).alias(f"dt{i}")]
    r = df.agg(*aggs).first()
    # distinct counts only where categories are asked for and a column is neither number nor datetime
    open_ = [c for i, c in enumerate(strs) if "category" in kinds and (min_parse_ratio > 0 or not (r[f"num{i}"] or r[f"dt{i}"]))]
    dist = {row["column"]: row["distinct"] for row in distinct_counts(df, open_).collect()}  # one row per column
    out = []
    for i, c in enumerate(strs):
        n = r[f"n{i}"] or 0
        need = max(1, min_parse_ratio * n)
        if r[f"num{i}"] >= need and r[f"num{i}"] > 0:
            out.append((c, "numeric"))
        elif r[f"dt{i}"] >= need and r[f"dt{i}"] > 0:
            out.append((c, "datetime"))
        elif r["__rows"] and c in dist and dist[c] / r["__rows"] < CATEGORY_RATIO:
            out.append((c, "category"))
        else:
            out.append((c, None))
    return out


def _apply_types(df: DataFrame, decisions, kinds=("numeric", "datetime", "category"),
                 formats=DATETIME_FORMATS) -> DataFrame:
    d = {c: k for c, k in decisions if k in kinds}
    cols = []
    for f in df.schema.fields:
        c, k = f.name, d.get(f.name)
        if k == "numeric":
            cols.append(F.when(F.col(c).rlike(NUMBER_RE), F.trim(F.col(c)).cast("double")).alias(c))
        elif k == "datetime":
            cols.append(parse_datetime(F.col(c), formats).alias(c))
        elif k == "category":
            cols.append(F.col(c).alias(c, metadata={**f.metadata, "category": True}))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def coerce_numeric(df: DataFrame, min_parse_ratio: float = 0.0) -> DataFrame:
    """String columns where at least one value (or ``min_parse_ratio`` of
    them) is a number become double; the other values become null."""
    return _apply_types(df, _type_decisions(df, min_parse_ratio, kinds=("numeric",)), kinds=("numeric",))


def coerce_datetime(df: DataFrame, min_parse_ratio: float = 0.0, formats=DATETIME_FORMATS) -> DataFrame:
    """String columns that are not numeric but where a value parses as a
    datetime become ``timestamp_ntz``."""
    return _apply_types(df, _type_decisions(df, min_parse_ratio, formats, kinds=("datetime",)), kinds=("datetime",), formats=formats)


def category_columns(df: DataFrame) -> DataFrame:
    """``(column, distinct_count, rows, ratio, is_category)`` for string columns."""
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    n = df.agg(F.count(F.lit(1)).alias("rows")).first()["rows"]
    d = distinct_counts(df, strs)
    ratio = F.when(F.lit(n) > 0, F.col("distinct") / F.nullif(F.lit(n), F.lit(0)))  # null without rows
    return d.select("column", F.col("distinct").alias("distinct_count"), F.lit(n).cast("long").alias("rows"),
                    F.round(ratio, 6).alias("ratio"), F.coalesce(ratio < CATEGORY_RATIO, F.lit(False)).alias("is_category"))


def correct_data_types(df: DataFrame, min_parse_ratio: float = 0.0) -> DataFrame:
    """Numeric, then datetime, then category typing of every string column."""
    return _apply_types(df, _type_decisions(df, min_parse_ratio))


def type_changes(df: DataFrame, min_parse_ratio: float = 0.0) -> DataFrame:
    """The change log of :func:`correct_data_types`: ``(column, change)``."""
    dec = [(c, k) for c, k in _type_decisions(df, min_parse_ratio) if k]
    return df.sparkSession.createDataFrame(dec, "column string, change string")


def _rare_values(df: DataFrame, share: float, max_distinct: int) -> dict[str, list]:
    cols = plot_categorical_columns(df)
    if not cols:
        return {}
    # pass 1 (cheap sketch): drop columns that certainly exceed max_distinct
    approx = df.agg(F.count(F.lit(1)).alias("__rows"),
                    *[F.approx_count_distinct(c, 0.02).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    rows = approx["__rows"]
    cand = [c for i, c in enumerate(cols) if approx[f"a{i}"] <= max_distinct * 1.25 + 5]
    if not cand:
        return {}
    # pass 2 (exact, bounded): value counts of the remaining low-cardinality
    # columns; at most ~max_distinct rows per column come back.
    vc = (df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                       for c in cand])))
          .filter(F.col("value").isNotNull()).groupBy("column", "value").count())
    got: dict[str, list] = {c: [] for c in cand}
    for r in vc.collect():
        got[r["column"]].append((r["value"], r["count"]))
    out = {}
    for c, vals in got.items():
        if len(vals) > max_distinct:
            continue
        rare = sorted(v for v, n in vals if n / rows < share)
        if rare:
            out[c] = rare
    return out


def collapse_rare(df: DataFrame, share: float = RARE_SHARE,
                  max_distinct: int = RARE_MAX_DISTINCT, other: str = OTHER) -> DataFrame:
    """In string columns with at most ``max_distinct`` distinct values,
    values whose share of all rows is below ``share`` become ``other``.  The
    rare set is at most ``max_distinct`` literals per column."""
    rare = _rare_values(df, share, max_distinct)
    cols = []
    for f in df.schema.fields:
        if f.name in rare:
            cols.append(F.when(F.col(f.name).isin(rare[f.name]), F.lit(other))
                        .otherwise(F.col(f.name)).alias(f.name, metadata=f.metadata))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def normalise_text(c: Column) -> Column:
    """Drop characters that are neither word nor space, squeeze whitespace,
    strip, lower-case.  Null stays null."""
    x = F.regexp_replace(c, NON_WORD_NON_SPACE, "")
    x = F.regexp_replace(x, WS_RUN, " ")
    return F.lower(F.trim(x))


def clean_text(df: DataFrame) -> DataFrame:
    """Normalise every free-text column (strings not flagged category)."""
    txt = set(text_columns(df))
    if txt:
        from tablelens.session import spread
        df = spread(df)
    return df.select(*[normalise_text(F.col(f.name)).alias(f.name, metadata=f.metadata)
                       if f.name in txt else F.col(f.name) for f in df.schema.fields])


def auto_clean(df: DataFrame, key: str | None = None) -> DataFrame:
    """Missing values (auto strategy), duplicates, types, rare categories,
    text - in this order.  The imputed frame is checkpointed once, because
    every later pass aggregates over it before rewriting it."""
    from tablelens.session import cut_lineage
    out = handle_missing(df, "auto", key=key)
    out = cut_lineage(remove_duplicates(out))
    out = correct_data_types(out)
    out = collapse_rare(out)
    return clean_text(out)
