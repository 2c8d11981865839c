"""The data behind each chart kind, reduced in Spark.

The reference ships every raw row to a browser plotting library.  Here each
chart returns the reduced table that defines it (bins, group statistics,
fitted lines, densities), so the output size depends on bins and groups,
never on rows.  Global bounds (min/max, quartiles) are one-row aggregates
read back as literals, which keeps the second pass a plain map + partial
aggregate with no join.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import (as_number, datetime_columns, datetime_named_columns,
                                         numeric_columns, plot_categorical_columns, skips_nan, validate)

# Chart defaults of the reference.
HIST_BINS = 50
PAIR_BINS = 20
VIOLIN_GRID = 512
PIE_MAX_DISTINCT = 20
PAIRPLOT_MAX_COLUMNS = 8
LINE_MAX_NUMERIC = 3
BAR_TOP_N = 10
PIE_TOP_N = 10
IQR_WHISKER = 1.5


class ChartInputError(ValueError):
    """Raised when a chart's guards fail (fewer than 2 rows, all-null column)."""


def _bounds(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """min, max and non-null count of each column plus the row count: one
    one-row aggregate, read back to the driver (2k+1 numbers)."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        v = as_number(df, c)
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.count(v).alias(f"n{i}")]
    r = df.agg(*aggs).first()
    out = {"__rows": r["__rows"]}
    for i, c in enumerate(cols):
        out[c] = (r[f"lo{i}"], r[f"hi{i}"], r[f"n{i}"])
    return out


def _guard(b: dict, *cols: str) -> None:
    if b["__rows"] < 2:
        raise ChartInputError("fewer than 2 rows: insufficient for a chart")
    for c in cols:
        if b[c][2] == 0:
            raise ChartInputError(f"column {c!r} contains only null values")


def bin_index(v: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin 0..bins-1 over [lo, hi]; the maximum lands in the last
    bin; lo == hi gives a single bin 0."""
    if hi is None or lo is None or hi <= lo:
        return F.when(v.isNotNull(), F.lit(0))
    width = float(hi) - float(lo)
    # least() skips nulls, so a missing value is kept out of the last bin here
    return F.when(v.isNotNull(), F.least(F.floor((v - F.lit(float(lo))) / F.lit(width) * F.lit(bins)).cast("int"),
                                         F.lit(bins - 1)))


@skips_nan
def histogram(df: DataFrame, column: str, bins: int = HIST_BINS) -> DataFrame:
    """Counts of ``bins`` equal-width bins: ``(bin, bin_lo, bin_hi, count)``."""
    validate(df, column)
    if column not in numeric_columns(df):
        raise ChartInputError(f"column {column!r} is not numeric")
    b = _bounds(df, [column])
    _guard(b, column)
    lo, hi, _ = b[column]
    v = F.col(column).cast("double")
    nb = bins if hi > lo else 1
    width = (hi - lo) / nb if hi > lo else 0.0
    return (df.select(bin_index(v, lo, hi, bins).alias("bin")).filter(F.col("bin").isNotNull())
            .groupBy("bin").count()
            .select("bin", F.round(F.lit(float(lo)) + F.col("bin") * F.lit(width), 4).alias("bin_lo"),
                    F.round(F.lit(float(lo)) + (F.col("bin") + 1) * F.lit(width), 4).alias("bin_hi"),
                    "count"))


@skips_nan
def scatter_trend(df: DataFrame, x: str, y: str, hue: str | None = None,
                  ndigits: int = 4) -> DataFrame:
    """Ordinary least squares line of y on x, per hue group when given:
    ``([hue], slope, intercept, r2, n)``."""
    validate(df, x, y, hue)
    b = _bounds(df, [x, y])
    _guard(b, x, y)
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    aggs = [F.round(F.regr_slope(ys, xs), ndigits).alias("slope"),
            F.round(F.regr_intercept(ys, xs), ndigits).alias("intercept"),
            F.round(F.regr_r2(ys, xs), ndigits).alias("r2"),
            F.regr_count(ys, xs).alias("n")]
    if hue:
        return df.filter(F.col(hue).isNotNull()).groupBy(hue).agg(*aggs)
    return df.agg(*aggs)


@skips_nan
def scatter_bins(df: DataFrame, x: str, y: str, bins: int = HIST_BINS) -> DataFrame:
    """2-D density of the scatter: ``(x_bin, y_bin, count)``."""
    validate(df, x, y)
    b = _bounds(df, [x, y])
    _guard(b, x, y)
    bx = bin_index(F.col(x).cast("double"), b[x][0], b[x][1], bins)
    by = bin_index(F.col(y).cast("double"), b[y][0], b[y][1], bins)
    return (df.select(bx.alias("x_bin"), by.alias("y_bin"))
            .filter(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
            .groupBy("x_bin", "y_bin").count())


@skips_nan
def box_stats(df: DataFrame, column: str, by: str | None = None,
              ndigits: int = 4) -> DataFrame:
    """Box plot numbers: quartiles (linear interpolation), fences at 1.5 IQR,
    whiskers = extreme values inside the fences, outlier count.  Grouped only
    when ``by`` is a string column, as the reference."""
    validate(df, column, by)
    grouped = by is not None and by in plot_categorical_columns(df)
    v = F.col(column).cast("double")
    keys = [by] if grouped else []
    base = df.select(*keys, v.alias("v")).filter(F.col("v").isNotNull())
    if grouped:
        base = base.filter(F.col(by).isNotNull())
    from tablelens.plans.quantiles import quantiles
    basic = base.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"))
    qs = quantiles(base, ["v"], [0.25, 0.5, 0.75], by=keys).drop("column")
    q = basic.join(qs, keys) if keys else _one_row_zip(basic, qs)
    q = q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                 F.col("q")[2].alias("q3"), "n", "min", "max")
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
         .withColumn("lower_fence", F.col("q1") - IQR_WHISKER * F.col("iqr"))
         .withColumn("upper_fence", F.col("q3") + IQR_WHISKER * F.col("iqr")))
    fences = q.select(*keys, "lower_fence", "upper_fence")
    if grouped:
        # per-group fences are one row per group: the planner broadcasts them
        # when small (size-checked by autoBroadcastJoinThreshold), else
        # shuffles; AQE splits a hot group's partition.
        j = base.join(fences, keys)
    else:
        f = fences.first()
        j = base.select("v", F.lit(f["lower_fence"]).alias("lower_fence"),
                        F.lit(f["upper_fence"]).alias("upper_fence"))
    inside = (F.col("v") >= F.col("lower_fence")) & (F.col("v") <= F.col("upper_fence"))
    w = j.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("n_outliers"))
    out = q.join(w, keys) if grouped else _one_row_zip(q, w)
    num = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence", "whisker_low",
           "whisker_high", "min", "max"]
    return out.select(*keys, *[F.round(c, ndigits).alias(c) for c in num], "n",
                      F.col("n_outliers").cast("long").alias("n_outliers"))


def _one_row_zip(a: DataFrame, b: DataFrame) -> DataFrame:
    """Side-by-side of two one-row frames without a cross join: the second
    row is read back (a handful of numbers) and added as literals."""
    r = b.first()
    return a.select("*", *[F.lit(r[c]).alias(c) for c in b.columns])


@skips_nan
def bar_top_n(df: DataFrame, x: str, y: str | None = None, top_n: int = BAR_TOP_N) -> DataFrame:
    """Top ``top_n`` categories of x by mean of y (or by count without y):
    ``(x, mean_y, sum_y, count)``; ties broken by category ascending."""
    validate(df, x, y)
    base = df.filter(F.col(x).isNotNull())
    if y:
        g = base.groupBy(x).agg(F.round(F.avg(y), 4).alias("mean_y"),
                                F.round(F.sum(y), 2).alias("sum_y"), F.count(y).alias("count"))
        g = g.filter(F.col("count") > 0)
        order = [F.col("mean_y").desc(), F.col(x)]
    else:
        g = base.groupBy(x).agg(F.count(F.lit(1)).alias("count"))
        order = [F.col("count").desc(), F.col(x)]
    g = g.orderBy(*order)
    return g.limit(top_n) if top_n and top_n > 0 else g


def restrict_to_top(df: DataFrame, x: str, y: str | None = None,
                    top_n: int = BAR_TOP_N) -> DataFrame:
    """Rows of ``df`` whose category is among the top ``top_n`` (the
    reference's ``isin``).  The key set has at most ``top_n`` rows, so the
    broadcast is bounded by the parameter, not by the data."""
    top = bar_top_n(df, x, y, top_n).select(x)
    return df.join(F.broadcast(top), x, "left_semi")


def heatmap(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Correlation heatmap cells rounded to 2 decimals (needs >= 2 numeric)."""
    from tablelens.operators.relations import corr_matrix
    cols = [c for c in (columns or numeric_columns(df)) if c in numeric_columns(df)]
    if len(cols) < 2:
        raise ChartInputError("heatmap needs at least two numeric columns")
    return corr_matrix(df, cols, ndigits=2)


@skips_nan
def pair_bins(df: DataFrame, columns: list[str], bins: int = PAIR_BINS,
              hue: str | None = None) -> DataFrame:
    """Scatter-matrix data without the diagonal: per unordered column pair,
    2-D bin counts ``([hue], x_col, y_col, x_bin, y_bin, count)``.

    Rows are first reduced to distinct bin tuples (partial aggregation before
    the shuffle), then pairs are exploded from that reduced table."""
    validate(df, *columns, hue)
    if len(columns) < 2:
        raise ChartInputError("pair plot needs at least two columns")
    b = _bounds(df, columns)
    _guard(b, *columns)
    keys = [hue] if hue else []
    binned = df.select(*keys, *[bin_index(F.col(c).cast("double"), b[c][0], b[c][1], bins).alias(f"b{i}")
                                for i, c in enumerate(columns)])
    reduced = binned.groupBy(*keys, *[f"b{i}" for i in range(len(columns))]).count()
    pairs = [F.struct(F.lit(a).alias("x_col"), F.lit(c).alias("y_col"),
                      F.col(f"b{i}").alias("x_bin"), F.col(f"b{j}").alias("y_bin"))
             for (i, a), (j, c) in combinations(list(enumerate(columns)), 2)]
    ex = reduced.select(*keys, "count", F.inline(F.array(*pairs)))
    ex = ex.filter(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
    return ex.groupBy(*keys, "x_col", "y_col", "x_bin", "y_bin").agg(F.sum("count").alias("count"))


@skips_nan
def line_series(df: DataFrame, x: str, y: str, hue: str | None = None,
                unit: str | None = "day", ndigits: int = 4) -> DataFrame:
    """y over x (per hue): datetime x is truncated to ``unit``; per point the
    mean, min, max and count of y: ``(x, [hue], mean_y, min_y, max_y, n)``."""
    validate(df, x, y, hue)
    b = _bounds(df, [x, y])
    _guard(b, x, y)
    xc = F.col(x)
    if unit and x in datetime_columns(df):
        xc = F.date_trunc(unit, xc).cast(df.schema[x].dataType)
    keys = [xc.alias(x)] + ([F.col(hue)] if hue else [])
    yv = F.col(y).cast("double")
    return (df.filter(F.col(x).isNotNull()).groupBy(*keys)
            .agg(F.round(F.avg(yv), ndigits).alias("mean_y"), F.min(yv).alias("min_y"),
                 F.max(yv).alias("max_y"), F.count(yv).alias("n")))


VIOLIN_SCHEMA = "grid_point int, x double, density double"


def _kde_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    """Gaussian kernel over one group's binned cells (<= grid rows), on a
    grid x grid matrix: cost independent of the group's row count."""
    keys = [c for c in pdf.columns if c.startswith("g_")]
    first = pdf.iloc[0]
    lo, hi, bw, n, grid = (float(first["lo"]), float(first["hi"]), first["bw"],
                           float(first["n"]), int(first["grid"]))
    j = np.arange(grid, dtype="float64")
    xs = lo + j * ((hi - lo) / (grid - 1)) if grid > 1 else np.array([lo])
    if bw is None or not np.isfinite(bw) or bw <= 0:
        dens = np.full(len(xs), np.nan)
    else:
        u = (xs[:, None] - pdf["center"].to_numpy()[None, :]) / bw
        dens = (np.exp(-0.5 * u * u) * pdf["cnt"].to_numpy()[None, :]).sum(axis=1) / (
            n * bw * math.sqrt(2.0 * math.pi))
    out = pd.DataFrame({"grid_point": np.arange(len(xs), dtype="int32"), "x": xs, "density": dens})
    for k in keys:
        out[k] = first[k]
    return out


@skips_nan
def violin_density(df: DataFrame, column: str, by: str | None = None,
                   grid: int = VIOLIN_GRID) -> DataFrame:
    """Kernel density of ``column`` (per ``by`` group) on ``grid`` points from
    min to max, Silverman bandwidth 0.9 min(sd, IQR/1.34) n^-1/5.

    Rows are first counted into ``grid`` cells per group (one shuffle of at
    most groups x grid rows); the kernel then runs per group on the cells,
    so no group ever holds its raw rows."""
    validate(df, column, by)
    from tablelens.session import ship_package
    ship_package(df.sparkSession)
    v = F.col(column).cast("double")
    keys = [by] if by else []
    base = df.select(*[F.col(k).alias(f"g_{k}") for k in keys], v.alias("v")).filter(F.col("v").isNotNull())
    gk = [f"g_{k}" for k in keys]
    if by:
        base = base.filter(F.col(gk[0]).isNotNull())
    from tablelens.plans.quantiles import quantiles
    st = base.groupBy(*gk).agg(
        F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.stddev_samp("v").alias("sd"))
    qv = quantiles(base, ["v"], [0.25, 0.75], by=gk).drop("column")
    st = st.join(qv, gk) if gk else _one_row_zip(st, qv)
    iqr = F.col("q")[1] - F.col("q")[0]
    spread = F.when(iqr > 0, F.least(F.col("sd"), iqr / 1.34)).otherwise(F.col("sd"))
    st = st.select(*gk, "n", "lo", "hi",
                   (F.lit(0.9) * spread * F.pow(F.col("n").cast("double"), -0.2)).alias("bw"),
                   F.lit(grid).alias("grid"))
    width = F.col("hi") - F.col("lo")
    cell = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width * grid).cast("int"),
                                     F.lit(grid - 1))).otherwise(F.lit(0))
    j = base.join(st.select(*gk, "lo", "hi"), gk) if gk else base.select(
        "v", *[F.lit(x).alias(c) for c, x in zip(["lo", "hi"], _one(st, ["lo", "hi"]))])
    cells = j.groupBy(*gk, cell.alias("cell")).agg(F.count(F.lit(1)).alias("cnt"))
    if gk:
        cells = cells.join(st, gk)
    else:
        r = st.first()
        cells = cells.select("*", *[F.lit(r[c]).alias(c) for c in ["n", "lo", "hi", "bw", "grid"]])
    cells = cells.withColumn(
        "center", F.col("lo") + (F.col("cell") + 0.5) * (F.col("hi") - F.col("lo")) / F.col("grid"))
    schema = ", ".join([f"{k} {df.schema[k[2:]].dataType.simpleString()}" for k in gk] + [VIOLIN_SCHEMA])
    if gk:
        out = cells.groupBy(*gk).applyInPandas(_kde_cells, schema)
    else:
        out = cells.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(
            lambda p: _kde_cells(p.drop(columns="__one")), schema)
    return out.select(*[F.col(g).alias(g[2:]) for g in gk], "grid_point",
                      F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


def _one(df: DataFrame, cols: list[str]) -> list:
    r = df.first()
    return [r[c] for c in cols]


@skips_nan
def pie_top_n(df: DataFrame, column: str, top_n: int | None = PIE_TOP_N,
              ndigits: int = 4) -> DataFrame:
    """Value counts, first ``top_n``, with each slice's share of the shown
    total: ``(value, count, share)``."""
    validate(df, column)
    vc = (df.filter(F.col(column).isNotNull()).groupBy(column).count()
          .orderBy(F.col("count").desc(), F.col(column)))
    if top_n and top_n > 0:
        vc = vc.limit(top_n)
    total = vc.agg(F.sum("count")).first()[0]  # of the shown slices: one number, whatever their count
    return vc.select(column, "count", F.round(F.col("count") / F.lit(total).cast("double"), ndigits).alias("share"))


# -- dispatch -----------------------------------------------------------------

# The two chart-kind vocabularies of the reference.
KIND_ALIASES = {
    "histogram": "histogram", "scatterplot": "scatter", "scatter": "scatter",
    "boxplot": "box", "box": "box", "barplot": "bar", "bar": "bar",
    "heatmap": "heatmap", "pairplot": "pairplot", "lineplot": "line", "line": "line",
    "violinplot": "violin", "violin": "violin", "piechart": "pie", "pie": "pie",
    "qqplot": "qq", "qq": "qq",
}


def chart(df: DataFrame, kind: str, **args) -> DataFrame | None:
    """Chart data by kind; unknown kinds give ``None`` as in the reference."""
    from tablelens.operators.qq import qq_plot
    k = KIND_ALIASES.get(kind)
    a = dict(args)
    col = a.get("column")
    if k == "histogram":
        return histogram(df, col)
    if k == "scatter":
        return scatter_trend(df, a["x_col"], a["y_col"], a.get("hue_col"))
    if k == "box":
        return box_stats(df, col, a.get("by_col"))
    if k == "bar":
        return bar_top_n(df, a["x_col"], a.get("y_col"), a.get("top_n") or 0)
    if k == "heatmap":
        return heatmap(df, a.get("columns"))
    if k == "pairplot":
        return pair_bins(df, a["columns"], hue=a.get("hue_col"))
    if k == "line":
        return line_series(df, a["x_col"], a["y_col"], a.get("hue_col"))
    if k == "violin":
        return violin_density(df, col, a.get("by_col"))
    if k == "pie":
        return pie_top_n(df, col, a.get("top_n"))
    if k == "qq":
        return qq_plot(df, col)
    return None
