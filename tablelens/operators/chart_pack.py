"""Chart pack for a whole table: which charts to draw (the plan) and their
data, computed with shared passes instead of one scan per chart."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import datetime_columns, datetime_named_columns, nan_to_null, numeric_columns, plot_categorical_columns
from tablelens.functions.special import probit
from tablelens.operators import charts
from tablelens.operators.qq import filliben
from tablelens.operators.relations import corr_matrix
from tablelens.plans.distinct import distinct_counts
from tablelens.plans.quantiles import quantiles
from tablelens.plans.ranking import value_runs_of
from tablelens.session import written

PLAN_SCHEMA = "chart string, column string, column2 string"
PACK_SCHEMA = "chart string, column string, column2 string, key string, x double, value double, count long"


def chart_pack_plan(df: DataFrame) -> DataFrame:
    """numeric -> histogram, box, qq; string -> bar (top 10), pie when at
    most 20 distinct; >= 2 numeric -> heatmap, pairplot when at most 8;
    each date/time-named column x first 3 numeric -> line."""
    nums, cats = numeric_columns(df), plot_categorical_columns(df)
    distinct = {}
    if cats:
        distinct = {r["column"]: r["distinct"] for r in distinct_counts(df, cats).collect()}
    plan = []
    for c in nums:
        plan += [("histogram", c, None), ("box", c, None), ("qq", c, None)]
    for c in cats:
        plan.append(("bar", c, None))
        if distinct[c] <= charts.PIE_MAX_DISTINCT:
            plan.append(("pie", c, None))
    if len(nums) >= 2:
        plan.append(("heatmap", None, None))
        if len(nums) <= charts.PAIRPLOT_MAX_COLUMNS:
            plan.append(("pairplot", None, None))
    for d in datetime_named_columns(df):
        for c in nums[:charts.LINE_MAX_NUMERIC]:
            plan.append(("line", d, c))
    return df.sparkSession.createDataFrame(plan, PLAN_SCHEMA)


def _cells(df: DataFrame, nums: list[str], cats: list[str], bins: int) -> tuple[DataFrame, list[tuple]]:
    """``(id, k, s, cnt, mean, n)``: every cell of every histogram, pair plot, line and value count, from ONE scan: rows are
    unpivoted to (chart, cell) and counted with map-side combine.  Written, as all those charts read it.  And the charts, by id."""
    b = charts._bounds(df, nums) if nums else {}
    at = {c: charts.bin_index(F.col(c).cast("double"), b[c][0], b[c][1], bins) for c in nums}
    pair_at = {c: charts.bin_index(F.col(c).cast("double"), b[c][0], b[c][1], charts.PAIR_BINS) for c in nums}
    none_k, none_s, none_x = F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("double")
    kinds, cells = [], []

    def add(chart: str, c1: str, c2: str | None, k, s, x, there) -> None:
        cells.append(F.when(there, F.struct(F.lit(len(kinds)).alias("id"), k.alias("k"), s.alias("s"), x.alias("x"))))
        kinds.append((chart, c1, c2))

    for c in nums:
        add("histogram", c, None, at[c].cast("long"), none_s, none_x, at[c].isNotNull())
    if 2 <= len(nums) <= charts.PAIRPLOT_MAX_COLUMNS:
        for x, y in combinations(nums, 2):
            k = (pair_at[x] * charts.PAIR_BINS + pair_at[y]).cast("long")
            add("pairplot", x, y, k, none_s, none_x, k.isNotNull())
    for d in datetime_named_columns(df):
        day = F.date_trunc("day", d).cast(df.schema[d].dataType) if d in datetime_columns(df) else F.col(d)
        for c in nums[:charts.LINE_MAX_NUMERIC]:
            add("line", d, c, none_k, day.cast("string"), F.col(c).cast("double"), F.col(d).isNotNull())
    for c in cats:
        add("bar", c, None, none_k, F.col(c), none_x, F.col(c).isNotNull())
    rows = df.select(F.explode(F.array(*cells)).alias("cell")).filter("cell IS NOT NULL").select("cell.*")
    counted = rows.groupBy("id", "k", "s").agg(F.count(F.lit(1)).alias("cnt"), F.avg("x").alias("mean"), F.count("x").alias("n"))
    return written(counted, "chart-cells"), kinds


def chart_pack(df: DataFrame, bins: int = charts.HIST_BINS) -> DataFrame:
    """Long-form data of the whole pack: ``(chart, column, column2, key, x, value, count)``.

    However many charts there are: one scan for bounds, one for the cells of all histograms, pair plots, lines and
    value counts, one for the runs of all Q-Q plots, and the fixed passes of quantiles (box) and correlation (heatmap).
    A Q-Q row is a run of equal values: key its first rank, x the normal quantile there, value the
    value, count the run's length.  Bar and pie keep the 10 most frequent values."""
    df = nan_to_null(df)
    nums, cats = numeric_columns(df), plot_categorical_columns(df)
    null = {t: F.lit(None).cast(t) for t in ("string", "double", "long")}
    parts = []

    def out(rows: DataFrame, chart, c1, c2, key, x=null["double"], value=null["double"], count=null["long"]) -> None:
        parts.append(rows.select(chart.alias("chart"), c1.alias("column"), c2.alias("column2"), key.cast("string").alias("key"), x.alias("x"),
                                 value.cast("double").alias("value"), count.cast("long").alias("count")))

    if nums or cats:
        cells, kinds = _cells(df, nums, cats, bins)
        name = lambda i: F.array(*[F.lit(k[i]).cast("string") for k in kinds])[F.col("id")]
        of = lambda chart: F.col("id").isin([i for i, k in enumerate(kinds) if k[0] == chart])
        out(cells.filter(of("histogram")), name(0), name(1), name(2), F.col("k"), count=F.col("cnt"))
        pair = F.concat_ws(",", F.floor(F.col("k") / charts.PAIR_BINS).cast("string"), (F.col("k") % charts.PAIR_BINS).cast("string"))
        out(cells.filter(of("pairplot")), name(0), name(1), name(2), pair, count=F.col("cnt"))
        out(cells.filter(of("line")), name(0), name(1), name(2), F.col("s"), value=F.col("mean"), count=F.col("n"))
        if cats:
            frequent = Window.partitionBy("id").orderBy(F.col("cnt").desc(), "s")
            distinct = cells.filter(of("bar")).groupBy("id").agg(F.count(F.lit(1)).alias("distinct"))
            top = (cells.filter(of("bar")).withColumn("rank", F.row_number().over(frequent)).filter(F.col("rank") <= charts.BAR_TOP_N).join(distinct, "id")
                   .withColumn("kind", F.explode(F.when(F.col("distinct") <= charts.PIE_MAX_DISTINCT, F.array(F.lit("bar"), F.lit("pie"))).otherwise(F.array(F.lit("bar"))))))
            out(top, F.col("kind"), name(1), null["string"], F.col("s"), count=F.col("cnt"))
    if nums:
        q = quantiles(df, nums, [0.0, 0.25, 0.5, 0.75, 1.0]).select("column", F.posexplode("q").alias("i", "q"))
        names = F.array(*[F.lit(x) for x in ("min", "q1", "median", "q3", "max")])
        out(q, F.lit("box"), F.col("column"), null["string"], names[F.col("i")], value=F.col("q"))
        runs, sizes = value_runs_of(df, nums)
        n = F.array(*[F.lit(max(x, 1)).cast("long") for x in sizes])[F.col("col")]
        points = runs.withColumn("x", F.round(probit(filliben(F.col("start"), n)), 6))
        out(points, F.lit("qq"), F.array(*[F.lit(c) for c in nums])[F.col("col")], null["string"], F.col("start"), F.col("x"), F.col("v"), F.col("cnt"))
    if len(nums) >= 2:
        out(corr_matrix(df, nums, 2), F.lit("heatmap"), F.col("col1"), F.col("col2"), null["string"], value=F.col("corr"))
    if not parts:
        return df.sparkSession.createDataFrame([], PACK_SCHEMA)
    return reduce(DataFrame.unionByName, parts)
