"""Chart pack, profile sink, chat log append: shared scans, lost nothing, rerun safely."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablelens.operators import chart_pack, charts, chat, qq
from tablelens.plans import ranking
from tablelens.sources import sinks


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation")


def _wide(spark, tmp_path, k):
    path = str(tmp_path / f"wide{k}")
    spark.range(400).select(F.to_timestamp_ntz(F.lit("2024-01-05 10:00:00")).alias("date"), *[(F.col("id") * (j + 3) % 17).cast("double").alias(f"x{j}") for j in range(k)],
                            *[F.concat(F.lit("v"), (F.col("id") % (j + 2)).cast("string")).alias(f"s{j}") for j in range(k)]).write.parquet(path)
    return spark.read.parquet(path)


def test_chart_pack_scans_do_not_grow_with_charts(spark, tmp_path, monkeypatch):
    """Jobs and scans are those of a narrow table, however many charts there are."""
    reads = []
    for k in (2, 7):
        df = _wide(spark, tmp_path, k)
        sc = spark.sparkContext
        sc.setJobGroup(f"pack{k}", "")
        out = chart_pack.chart_pack(df)
        out.write.format("noop").mode("overwrite").save()
        reads.append((_scans(out), len(sc.statusTracker().getJobIdsForGroup(f"pack{k}"))))
        kinds = {(r["chart"], r["column"], r["column2"]) for r in out.select("chart", "column", "column2").distinct().collect()}
        assert len([x for x in kinds if x[0] == "pairplot"]) == k * (k - 1) // 2
        assert len([x for x in kinds if x[0] == "line"]) == min(k, 3)
        assert len([x for x in kinds if x[0] in ("bar", "pie")]) == 2 * k
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert reads[0][0] == reads[1][0]
    assert reads[1][1] <= reads[0][1] + 2  # adaptive stages are jobs too


def test_chart_pack_equals_single_charts(spark):
    rows = [(i, float(v), None if i % 7 == 0 else f"c{i % 23}", dt.datetime(2024, 1, 1 + i % 3)) for i, v in enumerate([3, 1, 1, 2, 2, 2, 5, float("nan"), 9, 9] * 6)]
    df = spark.createDataFrame(rows, "k long, v double, s string, date timestamp_ntz")
    pack = chart_pack.chart_pack(df).collect()
    of = lambda chart, col, c2=None: {r["key"]: r for r in pack if (r["chart"], r["column"], r["column2"]) == (chart, col, c2)}
    assert {int(k): r["count"] for k, r in of("histogram", "v").items()} == {r["bin"]: r["count"] for r in charts.histogram(df, "v").collect()}
    want = {r["rank"]: (r["count"], r["value"], r["theoretical"]) for r in qq.qq_positions(df, "v").collect()}
    assert {int(k): (r["count"], r["value"], r["x"]) for k, r in of("qq", "v").items()} == want
    assert sum(r["count"] for r in of("qq", "v").values()) == 54
    lines = {str(r["date"]): (r["mean_y"], r["n"]) for r in charts.line_series(df, "date", "v").collect()}
    assert {k: (round(r["value"], 4), r["count"]) for k, r in of("line", "date", "v").items()} == lines
    assert len(of("bar", "s")) == 10 and not of("pie", "s")  # 23 values are too many for a pie
    assert {f"{r['x_bin']},{r['y_bin']}": r["count"] for r in charts.pair_bins(df, ["k", "v"]).collect()} == {
        k: r["count"] for k, r in of("pairplot", "k", "v").items()}


def test_chart_pack_of_edge_frames(spark):
    assert chart_pack.chart_pack(spark.createDataFrame([], "a double, s string, date timestamp_ntz")).filter("count > 0").count() == 0
    nulls = spark.createDataFrame([(None, None), (None, None)], "a double, s string")
    assert chart_pack.chart_pack(nulls).filter("count > 0").count() == 0
    assert chart_pack.chart_pack(spark.createDataFrame([(True,)], "b boolean")).count() == 0


@pytest.mark.parametrize("per_bucket", [2_000_000, 50])
def test_runs_of_several_columns(spark, per_bucket):
    df = spark.range(900).select((F.col("id") * 7 % 300).cast("double").alias("a"), F.lit(4.0).alias("b"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("c"))
    runs, sizes = ranking.value_runs_of(df, ["a", "b", "c"], rows_per_bucket=per_bucket)
    assert sizes == [900, 900, 300]
    got = {(r["col"], r["v"]): (r["cnt"], r["start"]) for r in runs.collect()}
    assert got == {**{(0, float(v)): (3, 3 * v + 1) for v in range(300)}, (1, 4.0): (900, 1), **{(2, float(3 * i)): (1, i + 1) for i in range(300)}}


def test_whole_profile_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", None), (3, None, 4.0)], "k long, s string, v double")
    when = dt.datetime(2024, 5, 6, 7, 8, 9)
    for _ in range(2):  # a rerun replaces
        path = sinks.write_profiles(df, "mine", str(tmp_path), when=when)
    assert path.endswith("/mine_20240506_070809")
    parts = sinks.read_profiles(spark, path)
    assert set(parts) == set(sinks.PROFILE_TABLES)
    assert parts["schema"].count() == 3 and parts["summary"].count() == 3 and parts["describe"].count() == 2
    assert {(r["column"], r["missing_count"]) for r in parts["missing"].collect()} == {("s", 1), ("v", 1)}


def test_chat_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "log")
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    schema = "conv_id long, id long, role string, content string, timestamp timestamp_ntz"
    first = spark.createDataFrame([(1, 1, "user", "a", day(1, 1)), (1, 2, "assistant", "b", day(1, 2)), (2, 1, "user", "c", day(3, 1))], schema)
    more = spark.createDataFrame([(1, 2, "assistant", "b", day(1, 2)), (1, 3, "user", "d", day(4, 1)), (1, 3, "user", "d", day(4, 1))], schema)
    for batch in (first, more, more, first, first.limit(0)):
        chat.append_messages(batch, path)
    got = [(r["conv_id"], r["id"], r["content"]) for r in chat.load_history(chat.read_log(spark, path)).collect()]
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "d"), (2, 1, "c")]
    assert chat.read_log(spark, path).columns == first.columns


def test_insight_digest_jobs_do_not_grow_with_columns(spark, tmp_path):
    from tablelens.operators import profile

    jobs = []
    for k in (2, 6):
        df = _wide(spark, tmp_path, k).withColumn("gap", F.when(F.col("x0") > 3, F.col("x0")))
        sc = spark.sparkContext
        sc.setJobGroup(f"digest{k}", "")
        got = {r["metric"]: r["value"] for r in profile.insight_digest(df).collect()}
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"digest{k}")))
        assert got["rows"] == 400 and got["columns"] == 2 * k + 2 and got["missing_columns"] == 1
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 3  # adaptive stages are jobs too
