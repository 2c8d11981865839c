"""Distributed exact ranks of one numeric column.

``row_number()`` without a partition key pulls every row into one task.
Instead: equal values are first collapsed into runs ``(v, cnt)`` (a hot
value becomes one row), runs are range-bucketed on cut points from a
quantile sketch, cumulative counts are taken inside each bucket, and bucket
offsets come from prefix sums over the (bounded, <= max_buckets rows)
bucket table.  Cut points are explicit literals, so re-running the plan
cannot move rows between buckets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.session import written

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 4096


def value_runs(df: DataFrame, column: str, rows_per_bucket: int = ROWS_PER_BUCKET,
               max_buckets: int = MAX_BUCKETS) -> tuple[DataFrame, int]:
    """Runs ``(v, cnt, start)`` with ``start`` the 1-based rank of the first
    occurrence of ``v`` in ascending order, and the number of non-null
    values ``n``."""
    v = F.col(column).cast("double")
    vals = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    runs = vals.groupBy("v").agg(F.count(F.lit(1)).alias("cnt"))
    st = runs.agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("runs")).first()
    n, n_runs = int(st["n"] or 0), int(st["runs"] or 0)
    if n == 0:
        return runs.withColumn("start", F.lit(1).cast("long")).limit(0), 0
    b = max(1, min(max_buckets, math.ceil(n_runs / rows_per_bucket)))
    if b > 1:
        probs = [i / b for i in range(1, b)]
        cuts = runs.agg(F.percentile_approx("v", probs, max(10000, 20 * b)).alias("c")).first()["c"]
        cuts = sorted(set(float(c) for c in cuts))
        # JVM-side binary search over the cut points (bucket i = number of
        # cut points <= v)
        from pyspark.ml.feature import Bucketizer
        splits = [float("-inf")] + cuts + [float("inf")]
        runs = Bucketizer(splits=splits, inputCol="v", outputCol="b").transform(runs)
        runs = runs.withColumn("bucket", F.col("b").cast("int")).drop("b")
    else:
        runs = runs.withColumn("bucket", F.lit(0))
    w = Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    within = F.sum("cnt").over(w) - F.col("cnt") + 1
    if b == 1:
        # a single bucket holds at most rows_per_bucket runs: no offsets
        ranked = runs.select("v", "cnt", within.cast("long").alias("start"))
        return ranked, n
    totals = runs.groupBy("bucket").agg(F.sum("cnt").alias("btot"))
    # at most max_buckets rows: a single-partition prefix sum is bounded
    offs = totals.select("bucket", (F.sum("btot").over(Window.orderBy("bucket")) - F.col("btot")).alias("off"))
    ranked = (runs.join(F.broadcast(offs), "bucket")
              .select("v", "cnt", (F.col("off") + within).cast("long").alias("start")))
    return ranked, n


def value_runs_of(df: DataFrame, columns: list[str], rows_per_bucket: int = ROWS_PER_BUCKET,
                  max_buckets: int = MAX_BUCKETS) -> tuple[DataFrame, list[int]]:
    """Runs ``(col, v, cnt, start)`` of several columns (by position) from one unpivoted scan, and the
    number of non-null values of each.  Cut points are exact quantiles, so a bucket holds at most ``rows_per_bucket``
    values that differ until ``max_buckets`` are used up."""
    from tablelens.plans.quantiles import quantile_table

    k = len(columns)
    wide = df.select(*[F.when(~F.isnan(x), x).alias(f"v{i}") for i, x in enumerate(F.col(c).cast("double") for c in columns)])
    row = wide.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(k)]).first()
    sizes = [row[f"n{i}"] for i in range(k)]
    b = max(1, min(max_buckets, math.ceil(max(sizes, default=0) / rows_per_bucket)))
    marked = wide.select("*", *[F.lit(0).alias(f"b{i}") for i in range(k)])
    if b > 1:
        from pyspark.ml.feature import Bucketizer

        cuts = {r["column"]: r["q"] for r in quantile_table(wide, [f"v{i}" for i in range(k)], [j / b for j in range(1, b)]).collect()}
        splits = [[float("-inf"), *sorted(set(cuts[f"v{i}"] or [0.0])), float("inf")] for i in range(k)]
        marked = Bucketizer(splitsArray=splits, inputCols=[f"v{i}" for i in range(k)], outputCols=[f"b{i}" for i in range(k)],
                            handleInvalid="keep").transform(wide)
    long = marked.select(F.inline(F.array(*[F.struct(F.lit(i).alias("col"), F.col(f"b{i}").cast("int").alias("bucket"), F.col(f"v{i}").alias("v"))
                                            for i in range(k)]))).filter(F.col("v").isNotNull())
    runs = written(long.groupBy("col", "bucket", "v").agg(F.count(F.lit(1)).alias("cnt")), "runs")
    within = Window.partitionBy("col", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    totals = runs.groupBy("col", "bucket").agg(F.sum("cnt").alias("total"))
    before = Window.partitionBy("col").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    offsets = totals.select("col", "bucket", (F.sum("total").over(before) - F.col("total")).alias("off"))
    ranked = runs.withColumn("within", F.sum("cnt").over(within) - F.col("cnt") + 1).join(offsets, ["col", "bucket"])
    return ranked.select("col", "v", "cnt", (F.col("off") + F.col("within")).cast("long").alias("start")), sizes


def expand_ranks(runs: DataFrame, chunk: int = 1_000_000, partitions: int | None = None) -> DataFrame:
    """One row per rank ``(rank, v)`` from runs.  A long run is first cut
    into chunks that are redistributed before being expanded, so a value
    holding a third of all rows is expanded by many tasks."""
    parts = partitions or runs.sparkSession.sparkContext.defaultParallelism
    chunks = runs.select("v", "cnt", "start", F.explode(F.sequence(
        F.lit(0).cast("long"), ((F.col("cnt") - 1) / chunk).cast("long"))).alias("ci"))
    chunks = chunks.select("v", (F.col("start") + F.col("ci") * chunk).alias("s"),
                           F.least(F.lit(chunk).cast("long"), F.col("cnt") - F.col("ci") * chunk).alias("len"))
    chunks = chunks.repartition(parts, "s")
    return chunks.select(F.explode(F.sequence(F.col("s"), F.col("s") + F.col("len") - 1)).alias("rank"), "v")
