"""Normal Q-Q plot data: ordered values against normal quantiles at the
order-statistic medians (Filliben), and the least-squares line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.special import probit
from tablelens.plans.ranking import expand_ranks, value_runs

# Filliben's order-statistic median constants.
FILLIBEN_A = 0.3175
FILLIBEN_B = 0.365


def filliben(rank: Column, n: int | Column) -> Column:
    """Uniform order-statistic median of ``rank`` (1-based) out of ``n``."""
    last = F.pow(F.lit(0.5), F.lit(1.0) / n) if isinstance(n, Column) else F.lit(0.5 ** (1.0 / n))
    mid = (rank.cast("double") - FILLIBEN_A) / (n + FILLIBEN_B)
    return F.when(rank == n, last).when(rank == 1, 1.0 - last).otherwise(mid)


def qq_positions(df: DataFrame, column: str, max_points: int | None = None,
                 ndigits: int = 6) -> DataFrame:
    """Every point of the plot, as runs of equal values: ``(rank, count,
    value, prob, theoretical)`` where ``rank`` is a run's first rank and prob
    and theoretical belong to it; the run's other points are the ``count - 1``
    ranks after it.  With ``max_points``, a thinned plot instead: at most so
    many evenly spaced ranks ``(point, rank, value, prob, theoretical)``; rank
    j maps to 1 + floor(j (n-1) / (m-1))."""
    runs, n = value_runs(df, column)
    if max_points is None:
        p = filliben(F.col("start"), max(n, 1))
        return runs.select(F.col("start").alias("rank"), F.col("cnt").alias("count"), F.col("v").alias("value"),
                           F.round(p, 8).alias("prob"), F.round(probit(p), ndigits).alias("theoretical"))
    m = min(n, max_points)
    if n == 0:
        return df.sparkSession.createDataFrame([], "point int, rank long, value double, prob double, theoretical double")
    if m == 1:
        pts = runs.filter(F.col("start") == 1).select(F.lit(0).alias("point"), F.lit(1).cast("long").alias("rank"), "v")
    else:
        s, e = F.col("start"), F.col("start") + F.col("cnt") - 1
        jlo = F.ceil((s - 1) * (m - 1) / F.lit(float(n - 1))).cast("int")
        jhi = (F.ceil(e * (m - 1) / F.lit(float(n - 1))) - 1).cast("int")
        pts = (runs.filter(jlo <= jhi).select("v", F.explode(F.sequence(jlo, jhi)).alias("point"))
               .select("point", (F.lit(1) + F.floor(F.col("point") * (n - 1) / F.lit(m - 1))).cast("long").alias("rank"), "v"))
    p = filliben(F.col("rank"), n)
    return pts.select("point", "rank", F.col("v").alias("value"), F.round(p, 8).alias("prob"),
                      F.round(probit(p), ndigits).alias("theoretical"))


def qq_fit(df: DataFrame, column: str, ndigits: int = 4) -> DataFrame:
    """Least-squares line of ordered values on normal quantiles over all n
    points: ``(n, slope, intercept, r)`` (the reference swaps slope and
    intercept when drawing; here the line is intercept + slope x)."""
    runs, n = value_runs(df, column)
    if n == 0:
        return df.sparkSession.createDataFrame([], "n long, slope double, intercept double, r double")
    # the quantile is projected once; aggregating the expression directly
    # would inline it into every aggregate and overflow the codegen method
    pts = expand_ranks(runs).select(probit(filliben(F.col("rank"), n)).alias("x"), F.col("v"))
    x, y = F.col("x"), F.col("v")
    return pts.agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope(y, x), ndigits).alias("slope"),
                   F.round(F.regr_intercept(y, x), ndigits).alias("intercept"),
                   F.round(F.corr(x, y), ndigits).alias("r"))


def qq_plot(df: DataFrame, column: str) -> DataFrame:
    """Chart data: all points (as runs) plus the fitted line's y at each run's first point."""
    fit = qq_fit(df, column).first()
    pos = qq_positions(df, column)
    if fit is None or fit["slope"] is None:
        return pos.withColumn("fitted", F.lit(None).cast("double"))
    return pos.withColumn("fitted", F.round(F.lit(fit["intercept"]) + F.lit(fit["slope"]) * F.col("theoretical"), 6))
