"""NaN is a missing value everywhere; all-null columns and empty frames have defined results."""

import math

import pytest
from pyspark.sql import functions as F

from tablelens.operators import charts, chat, cleaning, knn, profile, qq, query, relations

NAN = float("nan")


@pytest.fixture(scope="module")
def frame(spark):
    y = [5.0, NAN, 1.0, 9.0, 2.0, 3.5]
    return spark.createDataFrame([(k, "ab"[k % 2], float(k * k % 7), v, None) for k, v in enumerate(y)],
                                 "k long, g string, x double, y double, nothing double")


@pytest.fixture(scope="module")
def empty(frame):
    return frame.limit(0)


def _rows(df, key):
    return {r[key]: r for r in df.collect()}


def test_profile_of_nan(frame):
    d = _rows(profile.describe(frame), "column")["y"]
    assert d["count"] == 5 and d["mean"] == 4.1 and d["max"] == 9.0
    s = _rows(profile.column_summary(frame), "column")
    assert s["y"]["missing_count"] == 1 and s["y"]["mean_value"] == 4.1 and s["y"]["distinct_count"] == 5
    p = _rows(profile.profile_numeric(frame), "column")
    assert p["y"]["count"] == 5 and p["nothing"]["count"] == 0 and p["nothing"]["distinct_pct"] is None
    assert query.nunique(frame, ["y"]).first()["distinct"] == 5


def test_outliers_of_nan(frame):
    assert profile.outliers_zscore(frame, "y").count() == 0
    assert profile.outliers_iqr(frame, "y").count() == 0
    assert not [r for r in profile.quality_alerts(frame).collect() if r["column"] == "y" and r["alert"] == "CONSTANT"]


def test_relations_of_nan(frame):
    r = {(x["col1"], x["col2"]): x["corr"] for x in relations.corr_matrix(frame, ["x", "y"], None).collect()}
    pairs = [(float(k * k % 7), v) for k, v in enumerate([5.0, NAN, 1.0, 9.0, 2.0, 3.5]) if v == v]
    mx, my = (sum(p[i] for p in pairs) / len(pairs) for i in (0, 1))
    cov = sum((a - mx) * (b - my) for a, b in pairs)
    want = cov / math.sqrt(sum((a - mx) ** 2 for a, _ in pairs) * sum((b - my) ** 2 for _, b in pairs))
    assert r["x", "y"] == pytest.approx(want) and abs(want) < 0.99
    assert math.isfinite(relations.anova(frame, ["g"], ["y"]).first()["f_stat"])


def test_perfectly_separated_groups_are_reported(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    assert relations.anova(df).first()["f_stat"] == float("inf")


def test_charts_of_nan(frame):
    assert sum(r["count"] for r in charts.histogram(frame, "y").collect()) == 5
    assert charts.histogram(frame, "y").filter("bin_hi > bin_lo").count() > 1
    assert charts.bar_top_n(frame, "g", "y").first()["mean_y"] == 6.25  # b holds 9 and 3.5, and the NaN
    assert charts.violin_density(frame, "y").filter("density is null or isnan(density)").count() == 0
    assert charts.pie_top_n(frame, "g", None).agg(F.sum("share")).first()[0] == pytest.approx(1.0)


@pytest.mark.parametrize("op", [
    profile.describe, profile.column_summary, profile.profile_numeric, profile.profile_string, profile.quality_alerts, profile.top_values,
    profile.missing_report, profile.duplicate_rows, cleaning.category_columns, cleaning.missing_strategy, cleaning.correct_data_types,
    cleaning.type_changes, cleaning.collapse_rare, cleaning.auto_clean, relations.corr_matrix, relations.anova, relations.chi_square,
    relations.strong_correlations, query.nunique])
def test_empty_and_all_null_frames(frame, empty, op):
    op(empty).collect()
    op(frame.select(F.col("nothing"), F.col("nothing").cast("string").alias("s"))).collect()


def test_knn_without_key_and_with_a_string_key(spark):
    df = spark.createDataFrame([("r1", 1.0, 10.0), ("r2", 2.0, None), ("r3", 3.0, 30.0), ("r4", 4.0, NAN), ("r5", 100.0, 1000.0)],
                               "name string, a double, b double")
    for key in (None, "name"):
        got = {r["name"]: r["b"] for r in knn.impute_knn(df, key, k=2).collect()}
        assert got == {"r1": 10.0, "r2": 20.0, "r3": 30.0, "r4": 20.0, "r5": 1000.0}
    assert cleaning.handle_missing(df, "knn").filter("b is null or isnan(b)").count() == 0


def test_auto_clean_takes_the_knn_branch_without_key(spark):
    df = spark.range(40).select(F.col("id").alias("k"), F.when(F.col("id") % 4 != 0, F.col("id") * 2.0).alias("v"))
    assert cleaning.missing_strategy(df).first()["strategy"] == "knn"
    assert cleaning.auto_clean(df).filter("v is null").count() == 0


def test_quantiles_keep_groups_without_values(spark):
    from tablelens.plans.quantiles import quantiles

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 7.0)], "g string, v double")
    got = {r["g"]: r["q"] for r in quantiles(df, ["v"], [0.5], by=["g"]).collect()}
    assert got == {"a": [2.0], "b": None}
    many = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("v"))
    from tablelens.plans.quantiles import quantile_table

    assert quantile_table(many, ["v"], [0.0, 0.25, 0.5, 1.0], bits=8).first()["q"] == [0.0, 1249.75, 2499.5, 4999.0]


def test_qq_has_every_point(spark):
    df = spark.createDataFrame([(float(v),) for v in [3, 1, 1, 2, 2, 2, 5]], "v double")
    got = {r["value"]: (r["rank"], r["count"]) for r in qq.qq_positions(df, "v").collect()}
    assert got == {1.0: (1, 2), 2.0: (3, 3), 3.0: (6, 1), 5.0: (7, 1)}
    assert qq.qq_positions(spark.range(3000).select(F.col("id").cast("double").alias("v")), "v").count() == 3000


def test_switch_phrases_are_tried_in_order(spark):
    texts = ["use old notes then switch to sales", "open my file and then load wells", "go to the last dataset"]
    got = [r["switch_target"] for r in chat.message_intents(spark.createDataFrame([(t,) for t in texts], "content string")).collect()]
    assert got == ["sales", "wells", None]


def test_csv_folder_of_two_encodings(spark, tmp_path):
    from tablelens.sources.files import read_csv

    (tmp_path / "a.csv").write_bytes("k,t\n1,Straße é\n".encode())
    (tmp_path / "b.csv").write_bytes("k,t\n2,Straße é\n".encode("latin1"))
    assert [(r["k"], r["t"]) for r in read_csv(spark, str(tmp_path)).orderBy("k").collect()] == [(1, "Straße é"), (2, "Straße é")]


def test_csv_with_quoted_line_breaks(spark, tmp_path):
    from tablelens.sources.files import _by_form, load, read_csv

    plain, broken, latin = (tmp_path / x for x in ("plain.csv", "with break.csv", "latin.csv"))
    plain.write_text('k,t\n1,"a, ""b"""\n2,""\n3,5" x 7\n')
    broken.write_text('k,t\n4,"one\ntwo, ""three""\n\nfour"\n5,"""quoted""\nnext"\n')
    latin.write_bytes('k,t\n6,"é\nè"\n'.encode("latin1"))
    want = [(1, 'a, "b"'), (2, None), (3, '5" x 7'), (4, 'one\ntwo, "three"\n\nfour'), (5, '"quoted"\nnext'), (6, "é\nè")]
    rows = lambda df: [(r["k"], r["t"]) for r in df.orderBy("k").collect()]
    assert rows(read_csv(spark, str(tmp_path))) == want
    assert rows(load(spark, str(broken))) == want[3:5]
    assert rows(load(spark, str(plain))) == want[:3]
    assert rows(read_csv(spark, str(latin), encoding="ISO-8859-1")) == want[5:]
    forms = {(enc, many): len(files) for enc, many, files in _by_form(spark, str(tmp_path), None, None, ",")}
    assert forms == {("UTF-8", False): 1, ("UTF-8", True): 1, ("ISO-8859-1", True): 1}
    assert _by_form(spark, str(plain), None, None, ",") == [("UTF-8", False, str(plain))]
    (tmp_path / "tab").mkdir()
    (tmp_path / "tab" / "x.csv").write_text('k\tt\n1\t"a\nb"\n')
    assert rows(load(spark, str(tmp_path / "tab" / "x.csv"), sep="\t")) == [(1, "a\nb")]


def _messy_csv(rng, rows):
    """Text, and its rows, with quoted breaks, doubled quotes, empty and blank lines in fields, quotes in bare fields."""
    words = ["a", "b c", '"', '""', ",", "\n", "\n\n", "é", '",\n"', "x" * 30, '5" x 7']
    out, want = ["k,t,u\n"], []
    for k in range(rows):
        t, u = ("".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) for _ in range(2))
        out.append(f'{k},"{t.replace(chr(34), chr(34) * 2)}","{u.replace(chr(34), chr(34) * 2)}"\n' if rng.random() < 0.7 else f'{k},5" x 7,plain\n')
        want.append((k, t, u) if '5" x 7,plain' not in out[-1] else (k, '5" x 7', "plain"))
    return "".join(out), [(k, t or None, u or None) for k, t, u in want]


@pytest.mark.parametrize("most", [100_000, 0])
def test_csv_with_quoted_line_breaks_is_read_by_many_tasks(spark, tmp_path, monkeypatch, most):
    """Ranges of 300 bytes cut fields, doubled quotes and headers anywhere; the records are those of the whole file."""
    import random

    from tablelens.sources import csv_records
    from tablelens.sources.files import read_csv

    monkeypatch.setattr(csv_records.records, "__defaults__", ("UTF-8", ",", most))
    saved = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c, v in zip(saved, ("300", "1")):
            spark.conf.set(c, v)
        for seed in range(3):
            rng = random.Random(seed)
            text, want = _messy_csv(rng, 150)
            path = tmp_path / f"{seed}.csv"
            path.write_text(text.replace("\n", "\r\n") if seed == 1 else text, newline="")
            got = read_csv(spark, str(path), na_tokens=("",))
            assert got.columns == ["k", "t", "u"]
            whole = spark.read.csv(str(path), header=True, multiLine=True, escape='"', emptyValue="", schema="k long, t string, u string").na.fill("")
            rows = sorted((r["k"], r["t"], r["u"]) for r in got.na.fill("").collect())
            assert rows == sorted(map(tuple, whole.collect()))
            assert rows == [(k, t or "", u or "") for k, t, u in want]
            assert spark.read.text(str(path)).rdd.getNumPartitions() > 8
            ranges = csv_records.range_functions(csv_records._lines(spark, str(path), "UTF-8", ","))
            assert ranges.count() > 8 and csv_records.range_states(ranges).filter("open").count() > 0
        one = tmp_path / "one.csv"
        one.write_text('"k\nk",t\n1,"' + "line\n" * 400 + '"\n2,"open\nto the end\n')
        got = read_csv(spark, str(one))
        assert sorted((r[0], r[1]) for r in got.collect()) == [(1, "line\n" * 400), (2, "open\nto the end")]
    finally:
        for c, v in saved.items():
            spark.conf.set(c, v)
