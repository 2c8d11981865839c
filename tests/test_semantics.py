"""Edge rules on tiny inline frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tablelens.functions.columns import is_missing, nan_to_null
from tablelens.operators import chat, charts, cleaning, profile, query, relations, temporal


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert df.filter(is_missing(df, "x")).count() == 2
    assert nan_to_null(df).filter(F.col("x").isNull()).count() == 2


def test_groupby_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 5.0), ("a", 3.0)], "k string, v double")
    rows = query.groupby_agg(df, "k", "v").collect()
    assert [(r["k"], r["mean_v"]) for r in rows] == [("a", 2.0)]


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([(2.0,), (1.0,), (2.0,), (1.0,), (None,)], "x double")
    out = cleaning.impute_simple(df, "mode").collect()
    assert sorted(r["x"] for r in out) == [1.0, 1.0, 1.0, 2.0, 2.0]


def test_missing_strategy_thresholds(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert cleaning.missing_strategy(empty).first()["strategy"] == "median"
    low = spark.createDataFrame([(float(i), "x") for i in range(100)] + [(None, "y")], "a double, b string")
    assert cleaning.missing_strategy(low).first()["strategy"] == "drop"
    mid = spark.createDataFrame([(None if i % 5 == 0 else 1.0, "x") for i in range(100)], "a double, b string")
    assert cleaning.missing_strategy(mid).first()["strategy"] == "knn"


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(float(i), 2.0) for i in range(10)], "a double, c double")
    m = {(r["col1"], r["col2"]): r["corr"] for r in relations.corr_matrix(df).collect()}
    assert m[("a", "c")] is None and m[("c", "c")] is None and m[("a", "a")] == 1.0


def test_histogram_constant_column_one_bin(spark):
    df = spark.createDataFrame([(3.0,)] * 5, "x double")
    rows = charts.histogram(df, "x").collect()
    assert len(rows) == 1 and rows[0]["count"] == 5


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    rows = {r["bin"]: r["count"] for r in charts.histogram(df, "x", bins=10).collect()}
    assert max(rows) == 9 and sum(rows.values()) == 101


def test_chart_guards(spark):
    one = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(charts.ChartInputError):
        charts.histogram(one, "x")
    nulls = spark.createDataFrame([(None,), (None,)], "x double")
    with pytest.raises(charts.ChartInputError):
        charts.scatter_bins(nulls.withColumn("y", F.lit(1.0)), "x", "y")
    assert charts.chart(one, "no-such-kind") is None


def test_weekday_monday_zero_and_iso_week(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5, 6, 7),), (dt.datetime(2021, 1, 3),)], "ts timestamp_ntz")
    out = temporal.extract_datetime_features(df, "ts", ["dayofweek", "weekofyear", "second", "bogus"]).collect()
    assert out[0]["ts_dayofweek"] == 0 and out[0]["ts_second"] == 7
    assert out[1]["ts_weekofyear"] == 53 and out[1]["ts_dayofweek"] == 6
    assert "ts_bogus" not in out[0].asDict()
    assert temporal.extract_datetime_features(df, "nope").columns == ["ts"]


def test_to_datetime_modes(spark):
    df = spark.createDataFrame([("2024-01-05",), ("n/a",)], "d string")
    assert temporal.to_datetime(df, "d", "coerce").filter(F.col("d").isNull()).count() == 1
    assert temporal.to_datetime(df, "d", "ignore").schema["d"].dataType.simpleString() == "string"
    with pytest.raises(Exception):
        temporal.to_datetime(df, "d", "raise").collect()
    assert temporal.to_datetime(df, "missing_col").columns == ["d"]


def test_clean_text_unicode_and_null(spark):
    df = spark.createDataFrame([("  Straße  Über!!  x_1 ",), (None,)], "t string")
    out = [r["t"] for r in cleaning.clean_text(df).collect()]
    assert out == ["straße über x_1", None]


def test_clean_text_skips_category_columns(spark):
    df = spark.createDataFrame([("A!",), ("A!",), ("A!",), ("A!",), ("B?",)], "t string")
    typed = cleaning.correct_data_types(df)
    assert typed.schema["t"].metadata.get("category") is True
    assert {r["t"] for r in cleaning.clean_text(typed).collect()} == {"A!", "B?"}


def test_coerce_numeric_words(spark):
    df = spark.createDataFrame([("1d",), ("1_000",), (" 12 ",), ("3.5e1",)], "s string")
    assert [r["s"] for r in cleaning.coerce_numeric(df).collect()] == [None, None, 12.0, 35.0]
    strict = cleaning.coerce_numeric(df, min_parse_ratio=0.9)
    assert strict.schema["s"].dataType.simpleString() == "string"


def test_collapse_rare_share_counts_nulls(spark):
    rows = [("a",)] * 19 + [("b",)] + [(None,)] * 0
    df = spark.createDataFrame(rows + [(None,)] * 5, "c string")
    # b is 1 of 25 rows = 4% < 5% -> Other; a stays
    got = sorted((r["c"] or "<null>") for r in cleaning.collapse_rare(df).collect())
    assert got.count("Other") == 1 and got.count("a") == 19 and got.count("<null>") == 5


def test_duplicate_rows_null_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    r = profile.duplicate_rows(df).first()
    assert (r["rows"], r["distinct_rows"], r["duplicate_rows"]) == (3, 2, 1)


def test_two_row_group_beside_one_row_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", 2.0), ("c", 4.0)], "g string, v double")
    r = relations.anova(df).first()
    # b has one value and is left out: groups a and c, n = 4
    assert r["n_groups"] == 2 and r["n"] == 4


def test_intents_of_documented_prompts(spark):
    msgs = spark.createDataFrame([(p,) for p in [
        "Switch to sales data and show top 10 products", "use customer file", "because I said so",
        "list datasets", "/help", "Generate a pie chart of product categories", "embark now"]], "content string")
    out = chat.message_intents(msgs).collect()
    assert out[0]["switch_target"] == "sales" and out[0]["follow_up"] == "show top 10 products"
    assert out[1]["switch_target"] == "customer"
    assert out[2]["switch_target"] is None
    assert out[3]["list_intent"] and out[4]["command"] == "/help"
    assert out[5]["plot_intent"] and not out[6]["plot_intent"]


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = sorted(r["k"] for r in query.sample(df, 17, "k").collect())
    b = sorted(r["k"] for r in query.sample(df.repartition(7), 17, "k").collect())
    assert len(a) == 17 and a == b


def test_try_query_returns_error_text(spark):
    df = spark.range(3)
    out = query.try_query(spark, df, "SELECT nope FROM {df}").first()
    assert out["error"].startswith("Error executing query")


def test_ntz_micros_ignore_session_zone(spark):
    from tablelens.functions.columns import micros_to_ntz, ntz_micros
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 0, 123456),), (dt.datetime(1969, 12, 31, 23, 0),)],
                                   "t timestamp_ntz")
        out = df.select("t", ntz_micros(F.col("t")).alias("us")).withColumn("back", micros_to_ntz(F.col("us"))).collect()
        assert out[0]["us"] == 1710037800123456 and out[1]["us"] == -3600000000
        assert all(r["t"] == r["back"] for r in out)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_chart_dispatch_both_vocabularies(spark):
    rows = [(float(i), float(i % 7) * 2.5, "g%d" % (i % 3), dt.datetime(2024, 1, 1 + i % 5, i % 24)) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, g string, t timestamp_ntz")
    args = {"histogram": {"column": "x"}, "scatter": {"x_col": "x", "y_col": "y", "hue_col": "g"},
            "box": {"column": "y", "by_col": "g"}, "bar": {"x_col": "g", "y_col": "y", "top_n": 2},
            "heatmap": {"columns": ["x", "y"]}, "pairplot": {"columns": ["x", "y"]},
            "line": {"x_col": "t", "y_col": "y", "hue_col": "g"}, "violin": {"column": "y", "by_col": "g"},
            "pie": {"column": "g", "top_n": 2}, "qq": {"column": "x"}}
    long_names = {"scatter": "scatterplot", "box": "boxplot", "bar": "barplot", "line": "lineplot",
                  "violin": "violinplot", "pie": "piechart", "qq": "qqplot"}
    for kind, a in args.items():
        for name in {kind, long_names.get(kind, kind)}:
            out = charts.chart(df, name, **a)
            assert out is not None and out.count() > 0, name


def test_package_is_shipped_to_python_workers(spark):
    from tablelens.session import ship_package
    ship_package(spark)
    ship_package(spark)  # idempotent per SparkContext
    includes = spark.sparkContext._python_includes
    assert sum(1 for p in includes if p.endswith("tablelens.zip")) == 1
